import random

from tabsight.llm.line_dedup import line_dedup, patience

A = [f"This is line number {i} of the first document, long enough." for i in range(12)]


def left(make_docs, docs, **kw):
    return {r.doc_id: r.text for r in line_dedup(make_docs(docs), **kw).collect()}


def test_patience_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(8) for _ in range(rng.randrange(15))]
        b = [rng.randrange(8) for _ in range(rng.randrange(15))]
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert patience([9, 1, 2, 8], [1, 2]) == [(1, 0), (2, 1)]


def test_common_block_leaves_the_later_document(make_docs):
    got = left(make_docs, [(1, "\n".join(A)), (2, "\n".join(["My own opening line, quite different."] + A[3:7] + ["And my own ending, different too."])),
                           (3, "Nothing in common here at all, honestly.\nSecond line without a twin anywhere.")])
    assert got[1] == "\n".join(A)
    assert got[2] == "My own opening line, quite different.\nAnd my own ending, different too."
    assert got[3].count("\n") == 1


def test_exact_copies_keep_only_the_first(make_docs):
    t = "\n".join(A)
    got = left(make_docs, [(5, t), (3, t), (9, t)])
    assert got == {3: t, 5: "", 9: ""}


def test_common_line_without_other_overlap_stays_beyond_rare(make_docs):
    common = "All rights reserved, this line stands in every document."
    docs = [(k, f"{common}\nUnique content of document {k}, nothing like the others {k * 7919}.") for k in range(8)]
    assert all(common in t for t in left(make_docs, docs, rare=3).values())
    assert sum(common in t for t in left(make_docs, docs, rare=50).values()) == 1


def test_short_blocks_stay(make_docs):
    assert left(make_docs, [(1, "short\nabc"), (2, "short\nxyz")]) == {1: "short\nabc", 2: "short\nxyz"}


def test_edge_rows(make_docs):
    t = "\n".join(A)
    docs = make_docs([(1, None), (2, ""), (None, t), (4, t), (4, t), (6, "\n\n \n"), (7, A[0] + "\n" + A[0])])
    rows = line_dedup(docs, count="n_removed").collect()
    assert len(rows) == 7
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.text, r.n_removed))
    assert by[1] == [(None, 0)] and by[2] == [("", 0)] and by[6] == [("\n\n \n", 0)]
    assert by[None] == [(t, 0)] and by[4] == [("", 12)] * 2
    assert by[7][0][1] >= 1
    assert line_dedup(make_docs([])).collect() == []
    assert set(line_dedup(docs).columns) == set(docs.columns)


def test_many_copies_make_linear_work(make_docs):
    t = "\n".join(A)
    got = left(make_docs, [(k, t + f"\nEnding number {k} of this copy, which no other has.") for k in range(120)])
    assert got[0].startswith(A[0]) and all(got[k] == f"Ending number {k} of this copy, which no other has." for k in range(1, 120))


def test_line_of_many_documents_stays_in_the_first_only(make_docs):
    common = "All rights reserved, this line stands in every document."
    docs = [(k, f"{common}\nUnique content of document {k}, nothing like the others {k * 7919}.") for k in range(120)]
    assert [k for k, t in left(make_docs, docs).items() if common in t] == [0]


def test_block_whose_lines_have_different_owners(make_docs):
    x, y, z = "first part of it", "second part of it", "third part of it"
    got = left(make_docs, [(1, f"{x}\nother one"), (2, f"another\n{y}"), (3, f"{z}\nmore of it"), (4, f"{x}\n{y}\n{z}"), (5, f"own words\n{x}\n{y}\n\n{z}"),
                           (6, f"my own\n{x}\n{y}\n{z}\nmy end")])
    assert got[4] == f"{x}\n{y}\n{z}" and got[5] == f"own words\n{x}\n{y}\n\n{z}" and got[6] == "my own\nmy end"


def test_covers_alignment_with_every_earlier_document(make_docs):
    rng = random.Random(5)
    parts = ["word " * rng.randint(1, 12) + str(k) for k in range(30)]
    docs = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(30)
            lines += parts[at:at + rng.randint(1, 5)] + [f"only {k} {rng.random()}"] * rng.randint(0, 1) + [""] * rng.randint(0, 2)
        docs.append((k, "\n".join(lines)))
    got = {r.doc_id: r.text.split("\n") for r in line_dedup(make_docs(docs)).collect()}
    text = [t.split("\n") for _, t in docs]

    def runs(a, b, pairs):
        """Places in ``b`` of aligned runs with 40 characters; only a blank line may lie between."""
        out, run = set(), []
        for i, j in [*pairs, (-9, -9)]:
            if run and not (i - run[-1][0] == j - run[-1][1] and (i - run[-1][0] == 1 or i - run[-1][0] == 2 and not a[i - 1] and not b[j - 1])):
                if sum(len(b[q]) for _, q in run) >= 40:
                    out |= {q for _, q in run}
                run = []
            run.append((i, j))
        return out
    n = 0
    for k, b in enumerate(text):
        gone, whole = set(), set()
        for a in text[:k]:
            mine, theirs = [j for j, x in enumerate(b) if x], [i for i, x in enumerate(a) if x]
            gone |= runs(a, b, [(theirs[i], mine[j]) for i, j in patience([a[i] for i in theirs], [b[j] for j in mine])])
            whole |= {b[j] for j in mine if b[j] in a}
        it = iter([x for j, x in enumerate(b) if x and j not in gone])
        assert all(x in it for x in got[k] if x), k  # a subsequence: no aligned line is left
        assert all(x in got[k] for x in b if x and x not in whole)
        n += len(gone)
    assert n > 200


def test_a_column_with_the_counts_name_is_replaced(make_docs):
    from pyspark.sql import functions as F
    docs = make_docs(["same long line of forty characters or more, surely\nx", "same long line of forty characters or more, surely\ny"])
    out = line_dedup(docs.withColumn("n_removed", F.lit("q")), count="n_removed")
    assert out.columns.count("n_removed") == 1 and sorted(r.n_removed for r in out.collect()) == [0, 1]
