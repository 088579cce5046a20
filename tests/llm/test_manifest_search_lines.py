"""Manifest, ranked search and line dedup against plain versions, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lines, manifest, ranked
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, g string, leaf string, rank int, key string"
LINE = "The same forty characters stand in every one of them."


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LINE, "en", "a", 1), (3, LINE, "en", "a", 1),
            (4, f"  {LINE.upper()}\t\nshort\n{LINE}", "en", None, 5), (5, f"{LINE}\n\n{LINE}\r", "fr", "b", 1),
            (None, LINE, "fr", "b", 2), (6, "\n\n", None, "b", 3), (7, LINE + "\n" + "é" * 50_000, "", "b", None),
            (8, LINE.replace("same", "SAME") + " ", "en", "x", 1), (9, "word " * 40_000, "en", "x", 1)]
    return spark.createDataFrame([(*r, 1, "g", "l", 2, "k") for r in rows], SCHEMA)


# --- manifest -----------------------------------------------------------------------------------------

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def climbed(levels, i, node):
    """(proof, root) of node i replaced by ``node``"""
    proof = ""
    for nodes in levels[:-1]:
        run = nodes[i // 2 * 2:i // 2 * 2 + 2]
        proof += "".join(x for j, x in enumerate(run) if j != i % 2)
        run[i % 2] = node
        node, i = sha("".join(run)), i // 2
    return proof, node


def plain_manifest(rows, tampered):
    """Sorted (id, leaf, subroot, root, proof hash, folded root, verified) of row dicts"""
    groups = {}
    for r in rows:
        leaf = sha("".join(field(r[c]) for c in manifest.FIELDS))
        other = leaf
        if tampered(r["doc_id"]) and r["n_chars"] is not None:
            other = sha("".join(field(r[c] + 1 if c == "n_chars" else r[c]) for c in manifest.FIELDS))
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf, other))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels_of([x[1] for x in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        for i, (k, leaf, other) in enumerate(groups[g]):
            below, node = climbed(trees[g], i, other)
            above, folded = climbed(top, j, node)
            out.append((k, leaf, trees[g][-1][0], top[-1][0], sha(below + above), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def tampered(k):
    return k is not None and zlib.crc32(str(k).encode()) % 7 == 0


def check_manifest(df):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest.digests(manifest.manifest(manifest.leaves(df, {"n_chars": F.col("n_chars") + 1}, hit)))
    rows = [r.asDict() for r in df.collect()]
    assert sorted(map(tuple, found.collect()), key=str) == plain_manifest(rows, tampered)
    return rows


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest(spark, odd, monkeypatch, levels):
    """Blocks of 1024 leaves and of four, so that trees take several passes; runs of one at every level."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = check_manifest(docs)
    assert any(tampered(r["doc_id"]) for r in rows)
    check_manifest(odd)
    check_manifest(docs.where("lang = 'en'").limit(17))
    check_manifest(docs.limit(1))
    assert manifest.manifest(manifest.leaves(docs.limit(0))).count() == 0


def test_states_resume_without_left_siblings():
    nodes = [sha(str(i)).encode() for i in range(11)]
    block = manifest.Block(nodes, len(nodes))
    for i, node in enumerate(nodes):
        bare = [(state, b"", rights) for state, _, rights in block.path(i)]
        assert manifest.fold(node, bare) == block.root != manifest.fold(b"0" * 64, bare)


# --- ranked search -------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top=10):
    """[(item position, rank, id, score)] for [(id, text)] of both"""
    counts = [(k, Counter(WORD.findall((t or "").translate(brute.LOWER)))) for k, t in docs]
    counts = [(k, c) for k, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for i, (_, text) in enumerate(items):
        scores = []
        for k, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
                    for w, q in Counter(WORD.findall((text or "").translate(brute.LOWER))).items() if w in c)
            if s > 0:
                scores.append((-s, k is not None, k or 0, k))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top])]
    return out


def check_search(spark, docs, items):
    found = ranked.search(docs, spark.createDataFrame(items, "item_id long, text string, score long"))
    names = {}
    wanted = Counter((items[i][0], r, k, s) for i, r, k, s in plain_search(
        [(r.doc_id, r.text) for r in docs.collect()], [x[:2] for x in items]))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and not names
    assert Counter(map(tuple, found.collect())) == wanted
    return wanted


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, odd, monkeypatch, small):
    """Whole tables; then with tiles and blocks so small that every item meets several."""
    if small:
        for name, value in (("TILE_TERMS", 7), ("TILE_DOCUMENTS", 5), ("TERMS", 60)):
            monkeypatch.setattr(ranked, name, value)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text, 0) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()][:20 if small else None]
    assert check_search(spark, docs, items)
    twice = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 9").withColumn("doc_id", F.col("doc_id") + 10_000))
    strange = [(5, "SAME word characters", 0), (5, "SAME word characters", 1), (None, "éé stand short", 1), (7, None, 1),
               (8, "", 1), (9, "the the the THE one", 1), (10, ". , !", 1)]
    check_search(spark, twice, items[:3] + strange)
    check_search(spark, odd, strange)
    none = ranked.search(docs.limit(0), spark.createDataFrame(strange, "item_id long, text string, score long"))
    assert none.count() == 0
    assert ranked.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_tiles_stay_exact():
    """Tiles add up to the whole and no row of a tile can pass 2 ** 53, also where one term alone does."""
    rng = random.Random(1)
    room = ranked.EXACT // ranked.IMPACT - 1
    weights = np.array([25_000, 1, 0, 17_000, 9_999])
    items = [[(0, 10 ** 6), (1, 3), (2, 9)], [(3, 900_000), (0, 900_000)], [], [(t, rng.randint(1, 9)) for t in range(5)]]
    whole = np.zeros((4, 5))
    for names, matrix in ranked.item_tiles(items, weights):
        assert matrix.shape[1] <= ranked.TILE_TERMS and matrix.sum(axis=1).max() <= room
        assert matrix.sum(axis=1).max() * ranked.IMPACT < 2 ** 53
        for column, term in enumerate(names):
            whole[:, term] += matrix[:, column]
    for i, item in enumerate(items):
        for term, count in item:
            assert whole[i, term] == weights[term] * count


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(f"w{i}É" for i in range(3000))
    monkeypatch.setattr(ranked, "BATCH_BYTES", 50)
    parts = list(ranked.terms(text))
    assert len(parts) > 100 and [t.decode() for p in parts for t in p] == [f"w{i}É" for i in range(3000)]


# --- lines ------------------------------------------------------------------------------------------------

def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)


def plain_lines(rows, least=5, size=40):
    """Sorted (id, n_lines, n_dropped, hash) of [(id, text)]"""
    held = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= size:
                held.setdefault(key_of(line), set()).add(k)
    keeper = {x: max(k for k in ks if k is not None) for x, ks in held.items() if len(ks - {None}) >= least}
    out = []
    for k, t in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if key_of(x) not in keeper or keeper[key_of(x)] == k]
        out.append((k, len(whole), len(whole) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def check_lines(df, least=5):
    got = lines.digests(lines.dedup(df, least_documents=least)).collect()
    assert got == [] or got[0].__fields__ == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    wanted = plain_lines([(r.doc_id, r.text) for r in df.collect()], least)
    assert sorted(map(tuple, got), key=str) == wanted
    return sum(x[2] for x in wanted)


def test_line_dedup(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert check_lines(docs) > 0
    for least in (2, 5, 6):
        check_lines(odd, least)
    check_lines(odd.limit(0))
    check_lines(docs.unionByName(docs.where("doc_id % 3 = 0")))


def test_hot_lines(spark):
    """A line in a third of the documents, many times in some, beside many that few hold."""
    rng = random.Random(2)
    shared = [f"this line is shared by some documents, number {i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = [f"a line that only this document holds, {i} and {j}" for j in range(3)]
        hot = [" " * (i % 3) + LINE + "\t" * (i % 2)] * rng.randint(1, 4) if i % 3 == 0 else []
        body = own + hot + rng.sample(shared, 2)
        rng.shuffle(body)
        rows.append((i, "\n".join(body)))
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string")) > 300
