from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tabsight.llm import merkle
from tabsight.llm.merkle import ARITY, audit, build_manifest, fold, log_levels, postorder, read_levels, run_path, write_log


def h(texts):
    return sha256("".join(texts).encode()).hexdigest()


def record(*values):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Levels of a plain tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k:k + ARITY]) for k in range(0, len(levels[-1]), ARITY)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i - i % ARITY
        out.append((level[run:i], level[i + 1:run + ARITY]))
        i //= ARITY
    return out


def brute(rows, altered):
    """{(row number): result} for rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, record(*r)), k))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[0][2] for x in sorted(groups[s])]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), {}
    for s in names:
        for i, (_, k) in enumerate(sorted(groups[s])):
            path = siblings(trees[s], i) + siblings(top, names.index(s))
            cur = altered.get(k) or trees[s][0][i]
            for left, right in path:
                cur = h(left + [cur] + right)
            out[k] = (rows[k][0], trees[s][0][i], trees[s][-1][0], top[-1][0], h([x for p in path for q in p for x in q]), cur, cur == top[-1][0])
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 32, 33, 100, 255, 256])
@pytest.mark.parametrize("block", [0, 3])
def test_log_places_and_proofs(n, block):
    leaves = [sha256(b"%d" % k).digest() for k in range(n)]
    levels = log_levels(n, block)
    log = write_log(leaves, levels)
    nodes = read_levels(b"".join(log), n, levels)
    assert sorted(p for k in range(levels + 1) for p in postorder(k, n).tolist()) == list(range(len(log)))
    assert (nodes[0] if levels else log) == leaves
    for k in range(1, levels):
        assert nodes[k] == [merkle.digest(nodes[k - 1][j:j + ARITY]) for j in range(0, len(nodes[k - 1]), ARITY)]
    for i in range(n):
        assert fold(leaves[i], *run_path(nodes, i)) == log[-1]


def rows_of(sizes):
    k, out = 0, []
    for source, n in sizes:
        for _ in range(n):
            out.append((k, source, "en" if k % 3 else None, k % 7, f"Text {k} ÄB" if k % 3 != 2 else None))
            k += 1
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, rows, levels=merkle.LEVELS):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("grp", "block", "digest", "altered", "idx", "key", "part", "log")})
    change = F.when(F.col("doc_id") % 10 == 0, merkle.record_digest(
        [merkle.ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]))
    got = sorted(map(tuple, audit(build_manifest(docs, altered=change, levels=levels)).collect()), key=str)
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    want = brute(rows, {k: record(*r[:4], r[4] and r[4].translate(lower)) for k, r in enumerate(rows) if r[0] is not None and r[0] % 10 == 0})
    assert got == sorted(want.values(), key=str)
    return got


def test_equals_plain_tree(spark):
    got = check(spark, rows_of([("b", 300), (None, 17), ("a", 1), ("é", 16), ("Z", 256), ("", 40), ("hot", 900)]))
    assert {r[6] for r in got} == {True, False}
    # only rows whose text has capital letters fail
    assert all(r[6] == (r[0] % 10 != 0 or r[0] % 3 == 2) for r in got)


def test_many_rounds_and_many_sources(spark):
    check(spark, rows_of([(f"s{k}", 1 + k % 3) for k in range(300)] + [("long", 700)]), levels=1)


def test_nulls_ties_and_repeated_rows(spark):
    same = [(5, "s", "en", 3, "A b")] * 40 + [(None, "s", None, None, None)] * 20 + [(None, None, None, None, "x")] * 18
    check(spark, same + [(5, "s", "en", 3, "other"), (7, None, "en", 0, ""), (8, "t", "en", 9, "long " * 50_000), (2 ** 62 + 1, "s", "en", 9, "q")])


def test_one_row_and_empty_table(spark):
    got = check(spark, [(1, "s", "en", 1, "a")])
    assert got[0][1] == got[0][2] == got[0][3]
    check(spark, [])


def test_a_change_of_any_field_changes_the_root(spark):
    rows = rows_of([("a", 20), ("b", 3)])
    roots = {build_manifest(spark.createDataFrame(r, SCHEMA)).root for r in (
        rows, rows[:-1], [(99, *rows[0][1:])] + rows[1:], [(rows[0][0], "b", *rows[0][2:])] + rows[1:], [(*rows[1][:4], "")] + rows[1:])}
    assert len(roots) == 5
