"""Small tables with the awkward rows that every operator must take."""

import random
import re
import zlib

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(frame):
    """Extra columns with names that operators may use inside."""
    from pyspark.sql import functions as F

    for name in ("norm", "digest", "row", "n", "size", "key", "id", "cid", "comp", "block", "th", "score", "held_out", "h", "m", "target", "label_"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def awkward(seed=0, n=60):
    """Texts with copies, white-space variants, nulls, empty and long ones, and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 20, 60, 60]))]
        out.append((i, " ".join(words), rng.choice(["a", "b", "é", None])))
    long = " ".join(rng.choice(vocabulary) for _ in range(9000))
    out += [(n, None, "a"), (n + 1, "", None), (n + 2, " \n\t ", "b"), (n + 3, long, "c"), (n + 4, "A  b\nC " + long.upper(), "c")]
    out += [(n + 5, "same Text", "a"), (n + 6, "same\tText", "b"), (n + 7, "sameText", "a"), (n + 8, "same  Text", "a"), (n + 5, "same Text", "a")]
    out += [(None, "no id here", "a"), (None, "no id here", "a"), (n + 9, "x<|endoftext|>y  z", "a"), (7, "second row of an id", "a")]
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
