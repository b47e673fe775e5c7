"""Operators on words against brute force over the same rows."""

import collections
import re
import zlib

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_substring_dedup(docs, rows, empty):
    from srcweave.llm.substring_dedup import substring_dedup

    width = 35
    texts = [WORD.findall(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    want = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {j + k for j in range(len(w) - width + 1) if seen[tuple(w[j : j + width])] > 1 for k in range(width)}
        want.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert any(x[2] for x in want)
    assert substring_dedup(empty).count() == 0


def test_quality_rules(docs, rows, empty, spark, sf_dir):
    from srcweave.llm.quality_rules import quality_rules, trusted_ids

    plain = docs.select("doc_id", "text")
    got = quality_rules(plain, trusted_ids(spark, sf_dir)).select("doc_id", "rules.*").collect()
    want = []
    for i, t in rows:
        w = WORD.findall(t)
        n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    assert sorted((str(r[0]), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert all(r.kept == (not r.base_failed and r.score >= -0.2) for r in got)
    assert quality_rules(empty.select("doc_id", "text"), trusted_ids(spark, sf_dir)).count() == 0
    nobody = quality_rules(plain, spark.createDataFrame([], "doc_id long")).select("rules.*").collect()
    assert all(r.score == 0 and r.kept != r.base_failed for r in nobody)


def test_quality_scores_by_brute_force(docs, rows, spark, sf_dir):
    import math

    from srcweave.llm.quality_rules import quality_rules, trusted_ids
    from tests.llm import brute

    got = [(str(r[0]), r.score, r.kept) for r in quality_rules(docs.select("doc_id", "text"), trusted_ids(spark, sf_dir)).select("doc_id", "rules.*").collect()]
    want = brute.quality(rows, {r.doc_id for r in trusted_ids(spark, sf_dir).collect()})
    want = [(str(i), *x) for (i, _), x in zip(rows, want, strict=True)]
    assert len(got) == len(want) and any(not k for *_, k in got) and any(k for *_, k in got)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-9) and a[2] == b[2]


def test_quality_weights_are_the_log_likelihood_ratios(spark):
    import math

    from srcweave.llm import quality_rules as Q

    docs = spark.createDataFrame([(1, "good words here now"), (2, "bad ### ### ###"), (3, "good bad")], "doc_id long, text string")
    weights = Q.ratio_weights(docs, spark.createDataFrame([(1,)], "doc_id long")).first().weights
    pairs = Q.grams(docs, "text", "doc_id").collect()
    raw, target = collections.Counter(r.b for r in pairs), collections.Counter(r.b for r in pairs if r.doc_id == 1)
    for b, n in raw.items():
        p = (n + 1) / (len(pairs) + Q.BUCKETS)
        assert math.isclose(weights[b], math.log((target[b] + Q.PRIOR * p) / (sum(target.values()) + Q.PRIOR) / p), abs_tol=1e-9)
    assert len(weights) == Q.BUCKETS


def test_quality_target_counts_every_trusted_document(spark):
    import math

    from srcweave.llm import quality_rules as Q

    n = 30_000
    docs = spark.range(2 * n).selectExpr("id as doc_id", f"if(id < {n}, 'good', 'bad') as text").unionByName(spark.createDataFrame([(None, "none")] * 9, "doc_id long, text string"))
    weights = Q.ratio_weights(docs, spark.range(n).union(spark.range(5))).first().weights
    b = spark.range(1).select(Q._bucket(F.lit("good"))).first()[0]
    p = (n + 1) / (2 * (2 * n + 9) + Q.BUCKETS)  # two n-grams for each word
    assert math.isclose(weights[b], math.log((n + Q.PRIOR * p) / (2 * n + Q.PRIOR) / p), abs_tol=1e-9)


def test_license_scan(docs, rows, empty):
    from srcweave.llm.license_scan import PHRASES, license_scan

    got = {(str(r.doc_id), r.text or ""): r.license for r in license_scan(docs.drop("license")).collect()}
    for i, t in rows:
        w = ALNUM.findall(t.translate(FOLD))
        at = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in PHRASES}
        every = [k for x in at.values() for k in x]
        x = got[(str(i), t)]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(every), min(every, default=None), max(every, default=None))
        assert x.base_labels == sorted({PHRASES[p] for p in at if at[p]}) and set(x.base_labels) <= set(x.labels) and 0 <= x.score <= 1
    assert any("gpl" in x.labels for x in got.values())
    assert license_scan(empty.drop("license")).count() == 0


def test_license_templates_against_all_pairs(spark):
    from srcweave.llm import license_scan as L

    lines = [t for _, t in L.TEMPLATES] + [" ".join(t.split()[1:]) for _, t in L.TEMPLATES] + ["x y z", "the " * 30, "under the license of the public version 2 and this software"]
    docs = spark.createDataFrame([(i, f"first\n{x}\nlast") for i, x in enumerate(lines)], "doc_id long, text string")
    for r in L.license_scan(docs).collect():
        w = r.text.split()
        want = {label for label, t in L.TEMPLATES if any(10 * len(set(t.split()) & set(w[i : i + len(t.split())])) >= 9 * len(set(t.split())) for i in range(len(w)))}
        assert set(r.license.labels) - set(r.license.base_labels) == want - set(r.license.base_labels)


def test_license_templates_that_are_wrapped(spark):
    import textwrap

    from srcweave.llm import license_scan as L

    texts = ["\n".join(f" * {x}" for x in textwrap.wrap(t, width)) for _, t in L.TEMPLATES for width in (24, 40, 72)]
    texts += [f"Some text\nthat goes on before {x}\nand after it" for x in texts]
    texts += ["redistribution and use in source\n" + "one two three four five six\n" * 9 + "and binary forms with or without modification are permitted provided that the following conditions are met", "the license\n" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.license_scan(docs).collect():
        w = ALNUM.findall(r.text.translate(FOLD))
        want = {}
        for label, t in L.TEMPLATES:
            own, k = set(t.split()), len(t.split())
            blocks = [set(w[i : i + k]) for i in range(len(w))]
            share = max(len(own & b) / len(own) for b in blocks)
            if share >= L.CONTAINMENT:
                want[label] = max(share, want.get(label, 0))
        assert set(r.license.labels) == set(want) | set(r.license.base_labels), r.text
        assert r.license.score == (1 if r.license.n_base else max(want.values(), default=0))
        assert r.doc_id >= 2 * 3 * len(L.TEMPLATES) or L.TEMPLATES[r.doc_id // 3 % len(L.TEMPLATES)][0] in r.license.labels


def test_license_words_that_are_scattered_make_no_label(spark):
    from srcweave.llm import license_scan as L

    def scattered(template, gap):
        return " ".join(x for word in template.split() for x in [word, *["prose"] * gap])

    texts = [scattered(t, gap) for _, t in L.TEMPLATES for gap in (3, 60)] + ["the mit students who have released something under a " + "new " * 500 + "license"]
    got = L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.license.labels == [] and r.license.score == 0 for r in got)
    near = [scattered(t, 0) for _, t in L.TEMPLATES]
    assert all(r.license.labels for r in L.license_scan(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).collect())


def test_license_time_follows_the_text(spark):
    """Very many matches in one text: every word has a template, and five times the text takes about five times as long."""
    import time

    from srcweave.llm import license_scan as L

    def seconds(n):
        docs = spark.createDataFrame([(1, "Released under the MIT License. " * n)], "doc_id long, text string")
        began = time.perf_counter()
        r = L.license_scan(docs).first().license
        assert r.labels == ["mit"] and r.n_words == 5 * n and r.n_base == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 10 * max(seconds(8_000), 1)


def test_sharding(docs, rows, empty, spark):
    from srcweave.llm.sharding import SHARDS, permute, shard

    got = shard(docs).collect()
    again = shard(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
    counts = collections.Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == SHARDS
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    ordered = sorted(got, key=lambda r: r.row_number)
    assert [r.row_number for r in ordered] == list(range(len(got)))
    for n in (1, 2, 3, 4, 5, 16, 17, 1000, 4097):
        p = permute(range(n), n)
        assert sorted(p.tolist()) == list(range(n))
    assert permute(range(1000), 1000).tolist() != list(range(1000))
    assert shard(empty).count() == 0


def test_decontamination(docs, rows, empty, spark, sf_dir):
    from srcweave.llm import decontamination as D

    texts = [WORD.findall(t) for _, t in rows]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(500, None), (501, ""), (502, "a b c"), (503, " ".join(texts[5][:7])), (504, " ".join(texts[6][3:40])), (505, "zzz"), (506, "One"), (506, "one"), (507, "y z y z y z y z y z y z"), (507, "e")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = tuple(ALNUM.findall((t or "").translate(FOLD)))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[w[k : k + 10]].add(i)
    want = []
    for i, t in rows:
        w = tuple(ALNUM.findall(t.translate(FOLD)))
        hit, found = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if w[k : k + size] in wins:
                    hit |= set(range(k, k + size))
                    found |= wins[w[k : k + size]]
        want.append((str(i), len(w), sorted(hit), sorted(map(str, found))))
    got = sorted((str(r.doc_id), r.n_words, r.hits, r.items) for r in D.decontaminate(docs, bench).collect())
    assert got == sorted(want) and sum(bool(x[2]) for x in want) > 3
    old, D.BLOCK_WORDS = D.BLOCK_WORDS, 300
    try:
        assert sorted((str(r.doc_id), r.n_words, r.hits, r.items) for r in D.decontaminate(docs, bench).collect()) == got
    finally:
        D.BLOCK_WORDS = old
    assert D.decontaminate(empty, bench).count() == 0
    assert all(not r.hits for r in D.decontaminate(docs, bench.where("false")).collect())


def _pii_by_patterns(t):
    def luhn(s):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(s))) % 10 == 0

    def digits(s):
        return "".join(c for c in s if c in "0123456789")

    out = {"email": [], "ip": [], "card": [], "phone": []}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [f"{k}:{a}:{b}" for k, v in out.items() for a, b in v]


def test_pii(docs, rows, empty):
    from srcweave.llm.pii import BASE, find_pii

    got = sorted((str(r.doc_id), [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in BASE]) for r in find_pii(docs).collect())
    assert got == sorted((str(i), _pii_by_patterns(t)) for i, t in rows)
    assert find_pii(empty).count() == 0


def test_pii_against_patterns_on_odd_strings():
    import random

    from srcweave.llm.pii import BASE, KINDS, _automaton, find

    automaton, rng = _automaton(), random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("a.@@b-+ 11223344()5.67 é%4111") for _ in range(rng.randrange(60)))
        assert [f"{KINDS[k]}:{s}:{e}" for k, s, e in find(t, automaton) if KINDS[k] in BASE] == _pii_by_patterns(t), t


def test_pii_of_its_own_kinds():
    from srcweave.llm.pii import KINDS, _automaton, find

    t = 'See https://x.org/a?b=1. Account no: 12345678, token = "04dbeb" at 12 Old Mill Road; no cue 5 here'
    assert [(KINDS[k], t[s:e]) for k, s, e in find(t, _automaton())] == [("url", "https://x.org/a?b=1"), ("account", "12345678"), ("account", "04dbeb"), ("address", "12 Old Mill Road")]


def test_pii_runs_to_the_real_boundary():
    from srcweave.llm.pii import KINDS, _automaton, find

    automaton = _automaton()
    own = lambda t: [(KINDS[k], t[s:e]) for k, s, e in find(t, automaton) if KINDS[k] in ("account", "address")]
    key = "a1" * 60
    for cue, want in [
        ("IBAN: ", "DE89 3704 0044 0532 0130 00"), ("iban ", "DE89370400440532013000"), ("Iban: ", "FR14 2004 1010 0505 0001 3M02 606"), ("IBAN: ", "GB82-WEST-1234-5698-7654-32"),
        ("account number: ", "1234 5678 9012"), ("account: ", "ES91 2100 0418 4502 0005 1332"), ("token: ", key), ("api key: ", "sk_live_51HabcDEF"), ("token=", "v1.ab_c.d-9"),
    ]:
        for after in ("", " and more 5 words", ".", ", then", ") x"):
            assert own(cue + want + after) == [("account", want)], (cue, want, after)
    assert own("IBAN: DE88 3704 0044 0532 0130 00") == [] and own("account: none, token none") == []
    for want in [
        "Hauptstraße 12", "Berliner Straße 7a", "Karl-Marx-Straße 101", "Bahnhofstrasse 3", "12 rue de la Paix", "5 bis boulevard Voltaire", "12, avenue des Champs-Élysées", "3 place d'Italie", "8 Avenue Foch",
        "Calle Mayor 12", "calle de Alcalá, 45", "Avenida de la Constitución 3", "Plaza de España, nº 1", "12 Old Mill Road", "221b Baker Street", "7 Park Avenue",
    ]:
        for before, after in (("", ""), ("at ", ", and"), ("in der ", ". Next"), ("x (", ") 9")):
            assert own(before + want + after) == [("address", want)], (before, want, after)
    assert own("the main Straße is long, in place of 12 things, rue Foch, calle Mayor, la calle de noche 5, 12 replace Foch") == []


def test_addresses_of_any_length_in_linear_time():
    import time

    from srcweave.llm import pii

    a = pii._automaton()
    found = lambda t: [t[s:e] for k, s, e in pii.find(t, a) if k == 6]
    name = "X" + "y" * 300
    assert found(f"at 1234567 {name} {name} Street.") == [f"1234567 {name} {name} Street"]
    assert found(f"in der Haupt{name.lower()}straße 123456, Ort") == [f"Haupt{name.lower()}straße 123456"]
    assert found(f"au 1234567 bis, rue de {name} ici") == [f"1234567 bis, rue de {name}"]
    assert found("calle Mayor 1234567, ya") == ["calle Mayor 1234567"]
    assert found("12 Main\nStreet") == [] and found("a12 Main Street") == [] and found("12 Main, Street") == []
    began = time.perf_counter()
    for t in ("Straße" * 100_000, "A" + "Street" * 100_000, "12 " + "Street " * 100_000, "9" * 500_000 + " Main Street", "Rue " * 100_000, "1," * 200_000 + " Street"):
        found(t)
    assert time.perf_counter() - began < 20
