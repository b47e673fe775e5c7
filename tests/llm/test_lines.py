"""Line dedup against brute force."""

import collections
import random
import re


def _later_copies(rows, least, min_words=50):
    """{row: (n_lines, removed lines)} with the originals being the first by (id, place); rows must differ."""
    seqs = [[x for x in t.split("\n") if x] for _, t in rows]
    where = collections.defaultdict(list)
    for r, s in enumerate(seqs):
        for k, x in enumerate(s):
            if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= min_words:
                where[(x,)].append((rows[r][0] if rows[r][0] is not None else -1, r, k))
        for k in range(len(s) - least + 1) if least > 1 else range(len(s)):
            if least > 1 or (s[k],) not in where or (rows[r][0] if rows[r][0] is not None else -1, r, k) not in where[(s[k],)]:
                where[tuple(s[k : k + least])].append((rows[r][0] if rows[r][0] is not None else -1, r, k))
    gone = collections.defaultdict(set)
    for run, places in where.items():
        for _, r, k in sorted(places)[1:]:
            gone[r] |= set(range(k, k + len(run)))
    return {r: (len(s), gone[r]) for r, s in enumerate(seqs)}


def test_line_dedup(docs, rows, empty):
    from srcweave.llm.line_dedup import line_dedup

    for least in (1, 2, 3):
        want = []
        for r, (n, gone) in _later_copies(rows, least).items():
            k, kept = 0, []
            for x in rows[r][1].split("\n"):
                if not x or k not in gone:
                    kept.append(x)
                k += bool(x)
            text = rows[r][1] if not gone else "\n".join(kept) if any(kept) else ""
            want.append((str(rows[r][0]), n, len(gone), text))
        done = line_dedup(docs, min_lines=least, keep=("block", "size")).collect()
        assert sorted((str(x.doc_id), x.n_lines, x.n_removed, x.text or "") for x in done) == sorted(want), least
        assert all(sum(y.lines for y in x.runs) == x.n_removed and x.block == 2 and x.size == 3 for x in done)
        assert sum(x[2] for x in want) > 2
    assert line_dedup(empty, keep=("rules",)).count() == 0


def test_runs_are_maximal_and_first_copies_stay(spark):
    from srcweave.llm.line_dedup import line_dedup

    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "c\nd\n\na\nb"), (4, "a"), (5, "a\nb\na\nb"), (5, "q\nr"), (5, "q\nr"), (6, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text or "", [tuple(x) for x in r.runs]) for r in line_dedup(docs).collect())
    assert got == [(1, "a\nb\nc\nd", []), (2, "x\ny", [(1, 3)]), (3, "", [(0, 4)]), (4, "a", []), (5, "", [(0, 2)]), (5, "", [(0, 4)]), (5, "q\nr", []), (6, "", [])]


def test_copies_are_maximal_with_one_original_each(spark):
    from srcweave.llm.line_dedup import line_dedup

    long = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame(
        [(1, "\n".join(f"a{k}" for k in range(40))), (2, "b0\nb1\nb2"), (3, "x\n" + "\n".join(f"a{k}" for k in range(3, 30)) + "\ny\nb1\nb2"), (4, "p\n" + long), (5, "q\n" + long + "\nr"), (6, "a7\na8\nb0\nb1")],
        "doc_id long, text string",
    )
    got = {r.doc_id: [tuple(x) for x in r.copies] for r in line_dedup(docs).collect()}
    assert got == {1: [], 2: [], 3: [(1, 27, 1, 3), (29, 2, 2, 1)], 4: [], 5: [(1, 1, 4, 1)], 6: [(0, 2, 1, 7), (2, 2, 2, 0)]}
    short = {r.doc_id: r.text for r in line_dedup(docs, min_words=61).collect()}
    assert short[5] == "q\n" + long + "\nr"


def test_random_runs_over_many_blocks(spark, monkeypatch):
    """Few lines in many orders, several blocks and slices; the copies cover what is deleted and equal their originals."""
    from srcweave.llm import blocks
    from srcweave.llm.line_dedup import line_dedup

    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    pack, monkey = blocks.pack, lambda d, i, t, keep=(): pack(d, i, t, keep, block_bytes=400)
    monkeypatch.setattr(blocks, "pack", monkey)
    monkeypatch.setattr(blocks, "SLICE_VALUES", 5)
    lines = {i: [x for x in t.split("\n") if x] for i, t in rows}
    for least in (2, 3, 5):
        want = {rows[r][0]: g for r, (_, g) in _later_copies(rows, least).items()}
        for r in line_dedup(docs, min_lines=least).collect():
            covered = {k for c in r.copies for k in range(c.first, c.first + c.lines)}
            assert covered == want[r.doc_id] == {k for c in r.runs for k in range(c.first, c.first + c.lines)}, least
            for c in r.copies:
                assert lines[r.doc_id][c.first : c.first + c.lines] == lines[c.of_id][c.of_line : c.of_line + c.lines] and c.lines >= least
                assert (c.of_id, c.of_line) < (r.doc_id, c.first)


def test_ties_of_equal_rows_go_by_block(spark, monkeypatch):
    from srcweave.llm import blocks
    from srcweave.llm.line_dedup import line_dedup

    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda d, i, t, keep=(): pack(d, i, t, keep, block_bytes=10))
    docs = spark.createDataFrame([(5, "q one\nr two")] * 9 + [(None, "q one\nr two")], "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), r.text) for r in line_dedup(docs).collect())
    assert got == [("5", "")] * 9 + [("None", "q one\nr two")]
