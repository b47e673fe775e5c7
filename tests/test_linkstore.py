"""References kept up by change sets against a whole build."""

import collections
import random

from srcweave.operators.linkstore import LinkStore

SCHEMA = "file string, name string, kind string, n long"


def _whole(files):
    out = collections.Counter()
    for a, rows in files.items():
        for b, others in files.items():
            for name, kind, n in rows:
                for name2, kind2, m in others:
                    if (kind, kind2) == ("ref", "def") and name == name2:
                        out[a, b, name] += n * m
    return dict(out)


def test_change_sets_equal_a_whole_build(spark, tmp_path):
    dice = random.Random(4)
    rows = lambda: list({(f"n{dice.randrange(5)}", dice.choice(["def", "ref"])): None for _ in range(dice.randint(0, 4))})
    store, files = LinkStore(spark, str(tmp_path / "s")), {}
    assert store.edges().collect() == []
    for step in range(5):
        came = {f"f{dice.randrange(8)}": [(n, k, dice.randint(1, 2)) for n, k in rows()] for _ in range(3)}
        gone = {f for f in files if dice.random() < 0.2} | {f for f, r in came.items() if not r}
        came = {f: r for f, r in came.items() if r and f not in gone}
        files = {f: r for f, r in (files | came).items() if f not in gone}
        store.apply(spark.createDataFrame([(f, *r) for f, rs in came.items() for r in rs], SCHEMA), spark.createDataFrame([(f,) for f in gone], "file string"))
        if step == 3:
            store.compact()
        assert {(r.src, r.dst, r.name): r.n for r in store.edges().collect()} == _whole(files)
        assert collections.Counter(r.file for r in store.rows().collect()) == {f: len(rs) for f, rs in files.items() if rs}


def test_what_is_written_grows_with_the_change(spark, tmp_path):
    store = LinkStore(spark, str(tmp_path / "s"))
    base = spark.range(20_000).selectExpr("concat('f', id div 4) as file", "concat('n', id % 997) as name", "if(id % 4 = 0, 'def', 'ref') as kind", "1L as n")
    store.apply(base)
    old = {p for p in tmp_path.rglob("*.parquet")}
    size = lambda: sum(p.stat().st_size for p in set(tmp_path.rglob("*.parquet")) - old)
    one = store.apply(base.where("file = 'f7'").withColumn("n", base["n"] + 1))
    assert one < 150 and size() < 0.2 * sum(p.stat().st_size for p in old)
    assert store.apply(base.where("file = 'f7'").withColumn("n", base["n"] + 1)) == 0  # the same set again changes nothing
    assert store.rows().where("n = 2").count() == 4


def test_nulls_are_left_out(spark, tmp_path):
    store = LinkStore(spark, str(tmp_path / "s"))
    store.apply(spark.createDataFrame([("a", "x", "def", 1), ("b", "x", "ref", 1), ("b", "x", "ref", 2), (None, "x", "ref", 1), ("b", None, "ref", 1)], SCHEMA))
    assert [tuple(r) for r in store.edges().collect()] == [("b", "a", "x", 3)]
