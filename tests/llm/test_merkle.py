"""The manifest against a tree built row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rolefit.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, altered string, _x int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 2 * 2 : k // 2 * 2 + 2]
            paths[i].append((run[0], "") if k % 2 else ("", run[1] if len(run) > 1 else ""))
            at[i] = k // 2
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, digest(*map(encoded, row[:5]))))
    found = []
    for group in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(groups[group], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        found.append((own, *tree([leaf for _, leaf in own])))
    root, tops = tree([subroot for _, subroot, _ in found])
    for (own, subroot, paths), top in zip(found, tops, strict=True):
        for (row, leaf), below in zip(own, paths, strict=True):
            changed, path = list(row[:5]), below + top
            if None not in (row[0], row[3]) and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                changed[3] += 1
            node = digest(*map(encoded, changed))
            for left, right in path:
                node = digest(left, node, right)
            proof = digest(*(left + right for left, right in path))
            yield row[0], row[2], leaf, subroot, root, proof, node, node == root


def odd_rows():
    rows = [(i, f"s{i % 3}", ["de", "en", "ru", None][i * i % 4], i * 7, f"text {i}" * (i % 9)) for i in range(90)]
    rows += [(None, None, None, None, None), (None, "a", None, 3, "x"), (7, "", "ä", 3, ""), (7, "", "zz", 3, "日本"), (7, "", "", 0, None)]
    rows += [rows[5]] * 33 + [(10**12, "long", "en", 1, "x" * 400_000)]
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize("block_levels", [2, 10])
def test_equals_a_tree_built_row_by_row(spark, block_levels):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, FIELDS).repartition(6)
    got = merkle.manifest_proofs(docs, merkle.altered_counts(), block_levels)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)
    again = merkle.manifest_proofs(docs.repartition(2).drop("_x"), merkle.altered_counts(), block_levels)
    assert sorted(again.collect(), key=repr) == sorted(got.collect(), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_tables(spark, n):
    rows = [(i, "a", "en", 1, str(i), "", 1) for i in range(n)]
    got = merkle.manifest_proofs(spark.createDataFrame(rows, FIELDS), {}).collect()
    root, paths = tree([digest(*map(encoded, r[:5])) for r in rows])
    assert {r.root for r in got} == {r.subroot for r in got} == {root}
    assert all(r.verified for r in got) and len(got) == n
    assert {r.proof_sha256 for r in got} == {digest(*(a + b for a, b in p)) for p in paths}


def test_empty_table(spark):
    none = spark.createDataFrame([], FIELDS)
    assert merkle.manifest_proofs(none, merkle.altered_counts()).count() == 0


def test_any_change_is_found(spark):
    rows = [(i, "a", "en", 1, str(i), "", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, FIELDS)
    for name, value in {"text": F.upper(F.concat("text", F.lit("a"))), "lang": F.lit(None), "source": F.lit("")}.items():
        got = merkle.manifest_proofs(docs, {name: F.when(F.col("doc_id") == 3, value).otherwise(F.col(name))})
        assert [r.doc_id for r in got.collect() if not r.verified] == [3]
