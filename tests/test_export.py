import random

import pytest

from vecatlas.operators.export import export_manifest


def split_name(name):
    at = name.rfind(".")
    return (name[:at], name[at:]) if 0 < at < len(name) - 1 else (name, "")


def sequential(paths, taken):
    used, result = set(taken), []
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        stem, ext = split_name(name)
        target, n = name, 2
        while target in used:
            target, n = f"{stem} ({n}){ext}", n + 1
        used.add(target)
        result.append(target)
    return result


def exported(spark, paths, taken=()):
    sources = spark.createDataFrame(list(enumerate(paths)), "ordinal long, src_path string").repartition(3)
    held = spark.createDataFrame([(t,) for t in taken], "name string")
    rows = export_manifest(sources, held).orderBy("ordinal").collect()
    assert [r["src_path"] for r in rows] == list(paths)
    return [r["target_name"] for r in rows]


def test_literal(spark):
    assert exported(spark, ["x/a.png", "y/a.png", "z/a (2).png"]) == ["a.png", "a (2).png", "a (2) (2).png"]


def test_one_name_for_most_sources(spark):
    paths = [f"/{i}/same.png" if i % 3 else f"/{i}/{i}.png" for i in range(300)]
    assert exported(spark, paths) == sequential(paths, [])


@pytest.mark.parametrize("seed", range(2))
def test_random_clashes(spark, seed):
    rng = random.Random(seed)

    def name():
        copies = "".join(f" ({rng.choice([1, 2, 2, 3, 3, 4, 5, 9])})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2])))
        return rng.choice(["a", "a", "a", "b", ".h"]) + copies + rng.choice([".png", ".png", ""])

    paths = [f"/d{i}/{name()}" for i in range(60)]
    taken = {name() for _ in range(6)}
    assert exported(spark, paths, taken) == sequential(paths, taken)


def test_many_held_copies_take_few_passes(spark, monkeypatch):
    from vecatlas.operators import export

    passes, real = [], export.prefix_sum

    def counted(*args, **kwargs):
        passes.append(1)
        return real(*args, **kwargs)

    monkeypatch.setattr(export, "prefix_sum", counted)
    taken = ["a.png", *(f"a ({n}).png" for n in range(2, 502))]
    paths = ["/x/a.png", "/y/a.png", "/z/b.png"]
    assert exported(spark, paths, taken) == sequential(paths, taken)
    assert len(passes) <= 5
