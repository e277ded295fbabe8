"""Unique names where different names clash: against taking them one by one."""

import random

from photolake.plans import moves

NAMES = ["a.jpg", "a (1).jpg", "a (2).jpg", "a (3).jpg", "a (7).jpg", "a (1) (1).jpg", "a (2) (1).jpg", "a (1) (1) (1).jpg", "a (01).jpg", "a", "a (1)", ".jpg", "a.b.jpg", "a.b (1).jpg"]


def _one_by_one(asked, there):
    taken, last, out = set(there), {}, []
    for path in asked:
        where, _, name = path.rpartition("/")
        base, dot = (name[:-4], ".jpg") if name.endswith(".jpg") and name != ".jpg" else (name, "")
        n, got = last.get(path, 0), path
        while got in taken:
            n += 1
            got = f"{where}/{base} ({n}){dot}"
        last[path] = n
        taken.add(got)
        out.append(got)
    return out


def _assigned(spark, asked, there):
    plan = spark.createDataFrame([(i * 3, i, p, "extra") for i, p in enumerate(asked)], "key long, ord long, path string, _kind string").repartition(5)
    rows = moves.assign_unique(plan, spark.createDataFrame([(x,) for x in there], "path string")).collect()
    assert len(rows) == len(asked)
    got = {r.key // 3: r.final_path for r in rows}
    return [got[i] for i in range(len(asked))]


def test_many_mixed_families(spark):
    r = random.Random(11)
    asked, there = [], set()
    for family in range(250):
        names = r.sample(NAMES, r.randint(1, 8))
        asked += [f"d{family}/{r.choice(names)}" for _ in range(r.randint(0, 14))]
        there |= {f"d{family}/{r.choice(NAMES)}" for _ in range(r.randint(0, 3))}
    r.shuffle(asked)
    got = _assigned(spark, asked, there)
    assert got == _one_by_one(asked, there) and len(set(got)) == len(got) and not there & set(got)


def test_a_large_mixed_family(spark):
    """Claimants of one name and of a tenth of its numbers, in no order: all in one family."""
    r = random.Random(12)
    asked = ["d/a.jpg"] * 12_000 + [f"d/a ({r.randint(1, 20_000)}).jpg" for _ in range(3000)] + [f"d/a ({r.randint(1, 50)}) (1).jpg" for _ in range(300)]
    r.shuffle(asked)
    there = {f"d/a ({r.randint(1, 5000)}).jpg" for _ in range(500)}
    assert _assigned(spark, asked, there) == _one_by_one(asked, there)
