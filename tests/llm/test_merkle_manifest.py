import hashlib
import zlib

from lacuna.llm import merkle_manifest as M


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _siblings(levels, i):
    for level in levels[:-1]:
        run = i // 8 * 8
        yield level[run:i], level[i + 1 : run + 8]
        i //= 8


def _brute(rows):
    """The rows of the contract, from (doc_id, source, lang, n_chars, text)."""
    lower = str.maketrans(M.UPPER, M.LOWER)
    trees = {}
    for r in rows:
        changed = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            changed = (*r[:4], r[4].translate(lower))
        trees.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), _h(map(_field, r)), _h(map(_field, changed)), r[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:2])
        built[name] = _tree([x[1] for x in trees[name]])
    upper = _tree([built[n][-1][0] for n in names])
    root = upper[-1][0]
    out = []
    for at, name in enumerate(names):
        for i, (_, leaf, changed, doc_id) in enumerate(trees[name]):
            way = [*_siblings(built[name], i), *_siblings(upper, at)]
            proof = _h([x for left, right in way for x in (*left, *right)])
            folded = changed
            for left, right in way:
                folded = _h([*left, folded, *right])
            out.append((doc_id, leaf, built[name][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def _same(frame, **options):
    rows = [(None if r.doc_id is None else r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in M.verify_documents(frame, **options).collect()), key=str)
    assert got == _brute(rows)
    return got


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_documents(docs):
    got = _same(docs)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_odd_documents(odd):
    _same(odd)


def test_no_documents(none):
    assert M.verify_documents(none).count() == 0


def test_sizes_of_runs(spark):
    _same(spark.createDataFrame([(i * 7 - 20 + 1000 * n, "s", f"x{n}", i, f"Text {i}") for n in (1, 2, 8, 9, 64, 65) for i in range(n)], SCHEMA))


def test_one_leaf(spark):
    (row,) = _same(spark.createDataFrame([(1, "s", None, 1, "Text")], SCHEMA))
    assert row[1] == row[2] == row[3] and row[4] == _h([])


def test_many_languages(spark):
    names = [None, "", "Z", "a", "é", "日", "🙂", "￿", *(f"l{i}" for i in range(70))]
    _same(spark.createDataFrame([(i, None, names[i % len(names)], i, f"T{i}") for i in range(200)], SCHEMA))


def test_blocks_and_upper_versions(spark):
    """Blocks of 64 leaves: several stages of blocks, one language with most rows, repeated and null ids."""
    rows = [(i if i % 50 else None, "s", "hot", i, f"Text {i}") for i in range(4200)] + [(7, "s", "hot", 1, "Same")] * 200
    rows += [(i, "s", f"l{i % 3}", i, f"Other {i}") for i in range(300)]
    _same(spark.createDataFrame(rows, SCHEMA).repartition(5), depth=2)


def test_whole_blocks(spark):
    """More leaves than one block holds."""
    _same(spark.createDataFrame([(i, "s", "en", i, f"Text {i}") for i in range(2 * M.FANOUT**M.DEPTH + 3)], SCHEMA))


def test_versions_share_all_but_the_path(spark):
    rows = spark.createDataFrame([("t", i, _h([str(i)]), _h(["new", str(i)])) for i in range(100)], "tree string, id long, digest string, changed string")
    out = M.versions(M.build_manifest(rows, "id")).collect()
    assert {len(r.ancestors) for r in out} == {3}
    base = _tree([_h([str(i)]) for i in range(100)])
    for r in out:
        new = _tree([_h(["new", str(i)]) if i == r.id else _h([str(i)]) for i in range(100)])
        assert r.ancestors == [level[r.id // 8 ** (k + 1)] for k, level in enumerate(new[1:])]
        assert sum(a != b for x, y in zip(base, new, strict=True) for a, b in zip(x, y, strict=True)) == 4
