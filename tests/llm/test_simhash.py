import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from geoprev.llm import components, simhash


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    s = [] if not w else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    bits = Counter(b for x in s for b in range(64) if xxhash.xxh64_intdigest(x, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(s))


def linked(fps, threshold):
    """Component (least index) of each of a list of fingerprints, by all pairs."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= threshold:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_every_anchor_within_reach():
    """A value and any value one bit away share the anchor nearest to the first."""
    r = random.Random(1)
    for block in [*simhash.covers(simhash.EXACT), *simhash.covers(simhash.wide(1))[:3], *simhash.covers(simhash.wide(10**9))[:30:6]]:
        x = np.array([[r.getrandbits(1) for _ in range(256)] for _ in range(200)], np.uint8)
        home = block.home(x)
        for place in [None, *block.places]:
            y = x.copy()
            if place is not None:
                y[:, place] ^= 1
            row, anchor = block.within(y)
            reached = set(zip(row.tolist(), anchor.tolist()))
            assert len(reached) == len(row)
            assert all((i, int(h)) in reached for i, h in enumerate(home))


def test_fingerprints(spark, edge):
    got = {(r.doc_id): bytes(r.fp).hex() for r in simhash.fingerprints(edge, 4).collect()}
    for r in edge.collect():
        assert got[r.doc_id] == f"{plain_fingerprint(r.text, 4):016x}"
    assert got[1] == "0" * 16


def test_first_word_of_a_wide_fingerprint_is_the_narrow_one():
    h = simhash.shingle_hashes(b"a b c d e f g h i j k l", 5)
    assert simhash.fingerprint(h, 4)[:8] == simhash.fingerprint(h, 1) and len(simhash.fingerprint(h, 4)) == 32


@pytest.mark.parametrize("n", [1, 10**8, 10**9, 10**10, 10**11])
def test_blocks_for_any_number_of_fingerprints(n):
    """Anchors grow with the input, and of pairs as apart as sets of a similarity of 0.8 nearly all share a block up to one bit."""
    scheme, r = simhash.wide(n), np.random.default_rng(1)
    k = len(scheme.blocks[0])
    assert all(len(set(b)) == k and max(b) < 256 for b in scheme.blocks) and n * (k - 7) / 2 ** (k - 4) <= (simhash.CROWD if n < 10**11 else 10**4)
    differ = r.random((4000, 256)) < simhash.apart(0.8)
    share = np.any([differ[:, list(b)].sum(1) <= 1 for b in scheme.blocks], axis=0)
    assert share.mean() >= 0.95


@pytest.mark.parametrize("crowd", [64, simhash.CROWD])
def test_links_are_few_a_fingerprint(spark, crowd):
    """One large group of near copies gives a few links a fingerprint, not one for each anchor or pair of parts."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2, 256).astype(np.uint8)
    per_node = []
    for n in (400, 1600):
        fps = np.packbits(base ^ (r.random((n, 256)) < 0.04), axis=1)
        found = simhash.links(spark.createDataFrame([(x.tobytes(),) for x in fps], "fp binary"), simhash.wide(n), crowd).collect()
        per_node.append(len(found) / n)
    assert max(per_node) <= 24 and per_node[1] <= 1.3 * per_node[0], per_node


@pytest.mark.parametrize("crowd", [4, simhash.CROWD])
def test_links_equal_all_pairs(spark, crowd):
    """Clouds of near fingerprints, chains and strangers; a small crowd cuts every busy anchor into parts."""
    r = random.Random(7)
    fps = {0}
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f.to_bytes(8, "big"),) for f in fps], "fp binary")
    label = {bytes(x.node): bytes(x.label) for x in components.components(simhash.links(df, simhash.EXACT, crowd)).collect()}
    want = linked(fps, 4)
    for f, w in zip(fps, want):
        assert label.get(f.to_bytes(8, "big"), f.to_bytes(8, "big")) == fps[w].to_bytes(8, "big")


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (None, 3)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}


def test_near_duplicates_edge_cases(spark, edge, empty):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge, 4, simhash.EXACT).collect()}
    assert (got[1], got[2], got[3]) == (1, 1, 1) and got[9] == 8 and got[5] == 4 and got[7] == 6
    assert simhash.near_duplicates(edge, 4, simhash.EXACT).count() == edge.count()
    assert simhash.near_duplicates(empty, 5, simhash.wide(1)).count() == 0


def test_wide_scheme_finds_similar_texts(spark, words):
    """Copies of 300 words of which a few are changed (Jaccard of 0.85 and more) meet; strangers don't."""
    rows = []
    for i in range(120):
        w = words(300, i)
        rows.append((10 * i, " ".join(w)))
        r = random.Random(i)
        for k in range(3):
            v = list(w)
            for at in r.sample(range(300), 4):
                v[at] = f"x{k}{at}"
            rows.append((10 * i + 1 + k, " ".join(v)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert all(c // 10 == i // 10 for i, c in got.items())
    assert sum(c != i for i, c in got.items()) >= 0.95 * 360


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def components_of(sets, similarity):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_similar_links_equal_all_pairs():
    """Chains whose ends are apart, tight groups with an outlier, an empty set."""
    r = random.Random(3)
    sets = [set(range(k * 10, k * 10 + 100)) for k in range(12)] + [set(range(5000, 5100)) - {5000 + k} for k in range(30)] + [set(range(5050, 5150)), set()]
    r.shuffle(sets)
    found = simhash.similar_links([np.array(sorted(x), np.uint64) for x in sets], 0.8)
    label = list(range(len(sets)))
    for a, b in found:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert label == components_of([x or {-1} for x in sets], 0.8) and len(found) < len(sets)


@pytest.mark.parametrize("part_size", [500, 1 << 22])
def test_verified_links_equal_all_pairs(spark, words, part_size):
    texts = []
    for i in range(4):
        w = words(200, i)
        for k in range(8):
            w = list(w)
            w[20 * k + 10] = f"x{i}{k}"  # a chain: 10 of about 196 shingles a step
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    rows = simhash.described(docs, 5, 4).selectExpr("pmod(doc_id, 32) DIV 16 AS gid", "digest", "n", "th").distinct()
    name = {bytes(r.digest): r.doc_id for r in simhash.described(docs.filter("doc_id < 32"), 5, 4).collect()}
    got = components.components(simhash.verified_links(docs, rows, 5, 0.8, part_size=part_size))
    label = {name[bytes(r.node)]: bytes(r.label) for r in got.collect()}
    want = components_of([shingles(t) for t in texts], 0.8)
    assert len(label) == 32 and all((label[i] == label[j]) == (want[i] == want[j]) for i in range(32) for j in range(32))


def test_similar_texts_only(spark, words):
    """No link below a similarity of 0.8, though fingerprints are near (0.6 to 0.8) or equal (a line that prevails)."""
    rows = []
    for i in range(60):
        w = words(300, i)
        rows.append((10 * i, " ".join(w)))
        for k, n in enumerate((4, 8, 10, 12, 14)):
            v = list(w)
            for at in random.Random(i).sample(range(0, 300, 5), n):
                v[at] = f"x{k}{at}"
            rows.append((10 * i + 1 + k, " ".join(v)))
    line = "the same line of a page again and again " * 60
    rows += [(10000 + i, line + " ".join(words(60, 500 + i))) for i in range(3)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    sets = [shingles(t) for _, t in rows]
    of = {rows[i][0]: rows[x][0] for i, x in enumerate(components_of(sets, 0.8))}
    assert len(got) == len(rows) and all(of[c] == of[i] for i, c in got.items())
    assert sum(c != i for i, c in got.items()) >= 0.9 * sum(c != i for i, c in of.items())
