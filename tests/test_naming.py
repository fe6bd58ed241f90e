"""Names of paths against a plain form of the rules, on bent lines and awkward rows."""

import math
import random

from parasol.operators.naming import assign_names

PATHS = "edge_id long, name string, kind string, line array<array<double>>"
STREETS = "street_id long, name string, line array<array<double>>"


def spans(line):
    upto = 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        size = math.hypot(bx - ax, by - ay)
        yield upto, size, ax, ay, bx, by
        upto += size


def point(line, at):
    for upto, size, ax, ay, bx, by in spans(line):
        if at <= upto + size and size:
            t = max(0.0, (at - upto) / size)
            return ax + t * (bx - ax), ay + t * (by - ay)
    return tuple(line[-1])


def project(line, x, y):
    best = (math.inf, 0.0)
    for upto, size, ax, ay, bx, by in spans(line):
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size**2)) if size else 0.0
        d = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
        if d < best[0]:
            best = (d, upto + t * size)
    return best


def bearing(line, x, y):
    at = project(line, x, y)[1]
    (ax, ay), (bx, by) = point(line, max(at - 2, 0)), point(line, at + 2)
    return math.degrees(math.atan2(bx - ax, by - ay)) % 180


def middle(values):
    return sorted(values)[len(values) // 2]


def plain(path, streets, parallel=True):
    _, name, kind, line = path
    if name:
        return "own", name, None
    if kind and ("crossing" in kind or "traffic_island" in kind):
        return "connector", None, None
    total = sum(s[1] for s in spans(line or []))
    n = max(3, int(total // 10))
    probes = [point(line, total * i / (n - 1)) for i in range(n)] if line and len(line) > 1 else []
    found = {}
    for _, street, other in streets:
        if not probes or not street or len(other) < 2:
            continue
        d = round(middle([project(other, *p)[0] for p in probes]), 6)
        turns = [abs(bearing(line, *p) - bearing(other, *p)) for p in probes]
        if d <= 30 and (not parallel or total < 5 or middle([min(t, 180 - t) for t in turns]) <= 30):
            found[street] = min(d, found.get(street, math.inf))
    ranked = sorted(found.items(), key=lambda f: (f[1], f[0]))
    along = "|".join(s for s, _ in ranked[:3]) or None
    if total < 5:
        return "too_short", None, along
    if not ranked:
        return "no_parent", None, None
    if len(ranked) == 1 or (ranked[1][1] > 0 and ranked[0][1] / ranked[1][1] <= 0.6):
        return "derived", ranked[0][0], None
    return "ambiguous", None, along


def bent(rng, size, vertices):
    x, y, turn = rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(0, 2 * math.pi)
    line = [[x, y]]
    for _ in range(vertices - 1):
        turn += rng.uniform(-0.6, 0.6)
        x, y = x + size * math.cos(turn), y + size * math.sin(turn)
        line.append([x, y])
    return line


def test_any_lines_equal_the_plain_rules(spark):
    rng = random.Random(7)
    # No length is a multiple of ten metres, where the number of probes would hang on rounding.
    streets = [(i, f"Street {rng.randrange(12)}", bent(rng, rng.uniform(15, 60), rng.randint(2, 7))) for i in range(60)]
    paths = [(i, None, "footway", bent(rng, rng.choice([0.8, 6.1, 26.3]), rng.randint(2, 5))) for i in range(120)]
    # A loop is nearest to its first end at both, and a line that goes back over itself to its way out.
    paths += [(500, None, None, [[50.0, 50.0], [90.0, 50.0], [90.0, 80.0], [50.0, 50.0]]), (501, None, None, [[100.0, 100.0], [160.0, 100.0], [100.0, 100.0]])]
    for parallel in (True, False):
        got = {r.edge_id: (r.outcome, r.name, r.fold_names) for r in assign_names(spark.createDataFrame(paths, PATHS), spark.createDataFrame(streets, STREETS), parallel).collect()}
        want = {p[0]: plain(p, streets, parallel) for p in paths}
        assert got == want
    assert {o for o, _, _ in want.values()} == {"derived", "ambiguous", "no_parent", "too_short"}


def test_awkward_rows(spark):
    far = [[0.0, 0.0], [100.0, 0.0]]
    streets = [(1, "Elm Street", [[0.0, 10.0], [100.0, 10.0]]), (2, "Elm Street", [[0.0, 12.0], [100.0, 12.0]]), (3, None, far), (4, "", far), (5, "Dot", [[1.0, 1.0]]), (6, "Still", [[50.0, 8.0], [50.0, 8.0]]), (7, "Nil", None)]
    paths = [(1, None, None, far), (2, "", "footway", far), (3, "Own", "crossing", None), (4, None, "traffic_island", far), (5, None, "footway", None), (6, None, "footway", [[0.0, 0.0]]), (7, None, "footway", []), (8, None, "footway", [[1.0, 1.0], [1.0, 1.0]])]
    got = {r.edge_id: (r.outcome, r.name, r.fold_names) for r in assign_names(spark.createDataFrame(paths, PATHS), spark.createDataFrame(streets, STREETS)).collect()}
    assert got[1] == got[2] == ("derived", "Elm Street", None)
    assert got[3] == ("own", "Own", None) and got[4] == ("connector", None, None)
    assert all(got[k] == ("too_short", None, None) for k in (5, 6, 7)) and got[8] == ("too_short", None, "Elm Street")
    none = assign_names(spark.createDataFrame([], PATHS), spark.createDataFrame(streets, STREETS))
    assert none.isEmpty()
