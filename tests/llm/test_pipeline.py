"""The pipeline's stages against brute force, each on what the one before it kept."""

import collections
import zlib

import numpy as np

from tests.llm import brute
from tests.llm.test_jaccard import _components
from tests.llm.test_lines import _later_copies


def test_stages(spark, sf_dir, docs):
    import corpus_pipeline as P

    from srcweave.llm.packing import tokenizer_path
    from srcweave.llm.quality_rules import trusted_ids
    from tokenizers import Tokenizer

    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.where("doc_id >= 9001 or doc_id is null").selectExpr("doc_id", "text", "'en' as lang", "'srcX' as source", "cast(length(text) as bigint) as n_chars")
    twice = real.limit(5)
    start = real.select(*P.COLUMNS).unionByName(odd).unionByName(twice).cache()
    first = P.quality(spark, start, sf_dir).cache()
    rows = [(r.doc_id, r.text or "") for r in start.collect()]
    judged = brute.quality(rows, {r.doc_id for r in trusted_ids(spark, sf_dir).collect()})
    kept = collections.Counter((str(i), t) for (i, t), (_, ok) in zip(rows, judged, strict=True) if ok)
    assert collections.Counter((str(r.doc_id), r.text) for r in first.collect()) == kept and first.columns == list(P.COLUMNS)
    assert 0 < first.count() < start.count()

    second = P.lines(spark, first, sf_dir).cache()
    before = [(r.doc_id, r.text or "") for r in first.collect()]
    gone = _later_copies(before, 2)
    left = collections.Counter(str(before[r][0]) for r, (n, g) in gone.items() if len(g) < n or n == 0)
    assert collections.Counter(str(r.doc_id) for r in second.collect()) == left
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = P.near_copies(spark, second, sf_dir).cache()
    rows = [(r.doc_id, r.text or "") for r in second.collect()]
    groups = {c for _, n, c in _components(rows) if n}
    assert sorted(str(r.doc_id) for r in third.collect() if r.text.strip()) == sorted(groups)

    fourth = P.benchmark(spark, third, sf_dir).cache()
    rows = [(r.doc_id, r.text or "") for r in third.collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = sorted(str(i) for (i, _), hit in zip(rows, brute.contaminated(rows, items), strict=True) if not hit)
    assert sorted(str(r.doc_id) for r in fourth.collect()) == clean and fourth.exceptAll(third).isEmpty() and fourth.columns == list(P.COLUMNS)
    assert third.count() > fourth.count() > 0

    pieces = P.packing(spark, fourth, sf_dir).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], np.uint32) for r in fourth.collect()}
    cut, full = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(want[p.doc_id])
        cut[p.doc_id].append((p.start, p.start + p.length))
        full[p.sequence_id].append((p.offset, p.offset + p.length))
    for spans, end in [*[(v, len(want[k])) for k, v in cut.items()], *[(v, None) for v in full.values()]]:
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and (spans[-1][1] == end if end else spans[-1][1] <= 2048)
    assert set(cut) == set(want)
    empty = start.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run(spark, sf_dir):
    import corpus_pipeline as P

    assert P.run(spark, sf_dir).count() > 0
