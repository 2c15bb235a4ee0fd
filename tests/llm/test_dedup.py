"""Near duplicates, line dedup, repeated strings and decontamination against plain versions."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tomeloom.llm import decontaminate, lines, near_dups, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(corpus, k, percent):
    rows = [(i, shingle_set(t, k)) for i, t in corpus if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(rows):
        for j, t in rows[:a]:
            n = len(s & t)
            if n and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in rows)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, corpus, k):
    assert sorted(tuple(r) for r in near_dups.near_duplicates(docs, k).collect()) == plain_components(corpus, k, 80)


def test_near_duplicates_block_by_block(docs, corpus, monkeypatch):
    monkeypatch.setattr(near_dups, "PAIR_ROWS", 0)
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    assert sorted(tuple(r) for r in near_dups.near_duplicates(docs, 2).collect()) == plain_components(corpus, 2, 80)


def test_keep_one_of_each(docs, corpus, none):
    kept = near_dups.keep_one_of_each(docs)
    want = sorted(i for i, _, c in plain_components(corpus, 5, 80) if i == c)
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns
    assert near_dups.keep_one_of_each(none).count() == 0


def plain_lines(corpus, least):
    """Text and number of lines removed by (doc_id, text)."""
    from tomeloom.llm.lines import _WHITE

    keys = {}
    for i, t in corpus:
        if i is not None:
            keys.setdefault(i, set()).add(t or "")
    order = sorted({(i, lines_key(t), t) for i, ts in keys.items() for t in ts})
    own = {(i, t): [x.strip(_WHITE) for x in t.split("\n") if x.strip(_WHITE)] for i, _, t in order}
    first, found = {}, []
    for i, _, t in order:
        ls = own[i, t]
        for s in range(len(ls)):
            e = n = 0
            while s + e < len(ls) and n < least:
                n, e = n + len(ls[s + e].split()), e + 1
            if n < least:
                break
            w = tuple(ls[s : s + e])
            found.append(((i, t), s, w))
            first.setdefault(w, ((i, t), s))
    gone = {}
    for doc, s, w in found:
        other, at = first[w]
        if (other, at) == (doc, s):
            continue
        a, b = own[doc], own[other]
        lo = hi = s
        while lo > 0 and lo - 1 - s + at >= 0 and a[lo - 1] == b[lo - 1 - s + at]:
            lo -= 1
        while hi < len(a) and hi - s + at < len(b) and a[hi] == b[hi - s + at]:
            hi += 1
        gone.setdefault(doc, set()).update(range(lo, hi))
    return gone


def lines_key(text):
    return KEYS[text]


KEYS = {}


@pytest.mark.parametrize("least", [4, 10])
def test_line_dedup(spark, docs, corpus, least):
    from pyspark.sql import functions as F

    for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).distinct().collect():
        KEYS[r.t] = r.k
    gone = plain_lines(corpus, least)
    got = lines.remove_repeated_lines(docs, least, removed_col="n_gone")
    assert got.columns == [*docs.columns, "n_gone"]
    want = []
    for i, t in corpus:
        if i is not None:
            text, n = lines._without_runs(t, [{"start": x, "end": x + 1} for x in sorted(gone.get((i, t or ""), ()))])
            want.append((i, text, n))
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted(((r.doc_id, r.text, r.n_gone) for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(n for _, _, n in want) > 10


def lines_by_all_places(texts, least):
    """Line numbers in runs of ``least`` words or more that any earlier place has, by trying every pair of documents and shift."""
    own = [t.split("\n") for t in texts]
    gone = [set() for _ in own]
    for d, a in enumerate(own):
        for e, b in enumerate(own[: d + 1]):
            for shift in range(1 if e == d else 1 - len(b), len(a)):
                i = max(0, shift)
                while i < min(len(a), len(b) + shift):
                    k = i
                    while k < min(len(a), len(b) + shift) and a[k] == b[k - shift]:
                        k += 1
                    if sum(len(x.split()) for x in a[i:k]) >= least:
                        gone[d].update(range(i, k))
                    i = k + 1
    return gone


def test_line_dedup_against_all_earlier_places(spark):
    rng = np.random.default_rng(3)
    hot = "a hot line of ten words that stands in many"
    texts = [f"{hot}\nfirst neighbour", f"other\n{hot}\nshort\ntail", f"more\n{hot}\nshort\ntail\nend", f"{hot}\nshort\nfirst neighbour"]
    pool = [" ".join(f"l{i}w{j}" for j in range(n)) for i, n in enumerate((1, 1, 2, 3, 4, 6, 11, 12))]
    texts += ["\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 12))) for _ in range(60)]
    got = lines.remove_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), removed_col="n_gone").collect()
    gone = lines_by_all_places(texts, 10)
    assert gone[2] == {1, 2, 3} and gone[3] == {0, 1}
    want = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.text, r.n_gone) for r in got} == want


def plain_strings(corpus, span):
    by_id = {}
    for i, t in corpus:
        if i is not None:
            by_id.setdefault(i, []).append((t or "").encode())
    seen, out = set(), []
    for i in sorted(by_id):
        fresh = set()
        for b in by_id[i]:
            cover = bytearray(len(b))
            for j in range(len(b) - span + 1):
                if b[j : j + span] in seen:
                    cover[j : j + span] = b"\1" * span
                fresh.add(b[j : j + span])
            kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
            out.append((i, len(b), sum(cover), sum(1 for j, c in enumerate(cover) if c and not (j and cover[j - 1])), hashlib.sha256(kept).hexdigest()))
        seen |= fresh
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 21, 2_000])
def test_repeated_strings(docs, corpus, none, monkeypatch, shard_bytes):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 8 * shard_bytes)
    assert sorted(tuple(r) for r in substrings.remove_repeated_strings(docs).collect()) == plain_strings(corpus, 50)
    assert substrings.remove_repeated_strings(none).count() == 0


def plain_overlaps(text, items, least=12, similarity=0.8):
    """Items that a stretch of the text matches, by trying every shift whose window hits a mask."""
    norm = lambda t: [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() or w for w in (t or "").split()]
    doc, out = norm(text), set()
    for no, item in items:
        w = norm(item)
        if len(w) < 5:
            continue
        masks = decontaminate.MASKS if len(w) >= 12 else ["1" * len(w)]
        for shift in range(-len(w), len(doc)):
            lo, hi = max(0, -shift), min(len(w), len(doc) - shift)
            eq = [w[j] == doc[j + shift] for j in range(lo, hi)]
            for m in masks:
                for s in range(len(eq) - len(m) + 1):
                    if all(eq[s + o] for o, c in enumerate(m) if c == "1"):
                        a, b = decontaminate._best_stretch(np.array(eq), s)
                        if b - a >= max(5, min(least, len(w))) and sum(eq[a:b]) >= similarity * (b - a):
                            out.add((no, lo + a, lo + a + shift, b - a, sum(eq[a:b])))
    return out


def test_overlaps(spark, none):
    item = " ".join(f"term{i}" for i in range(30))
    changed = item.split()
    changed[7] = changed[19] = "other"
    items = [(1, item), (2, "five short words are here"), (3, "too few words"), (4, None), (None, item), (1, item)]
    texts = [item, "Before. " + item.upper().replace(" ", ", ") + " after", "x " + " ".join(changed) + " y", " ".join(item.split()[:14]), " ".join(item.split()[:9]), "so five short words are here again", "too few words", "", None, item + " " + item, "clean text of many words " * 30]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    got = {r.doc_id: {tuple(o) for o in r.overlaps} for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert got == {i: plain_overlaps(t, [(1, item), (2, items[1][1]), (3, items[2][1])]) for i, t in enumerate(texts)}
    assert [i for i, o in got.items() if o] == [0, 1, 2, 3, 5, 9]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [4, 6, 7, 8, 10]
    assert decontaminate.find_overlaps(docs, bench.limit(0)).where("size(overlaps) > 0").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_overlaps_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(12)]
    docs = spark.createDataFrame([(i, f"a b {items[i][1]} c") for i in range(12)] + [(99, items[0][1] + " " + items[5][1])], "doc_id long, text string")
    got = {r.doc_id: sorted(o.item_id for o in r.overlaps) for r in decontaminate.find_overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [i] for i in range(12)} | {99: [0, 5]}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    other = np.unique(np.concatenate([base[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    sig = near_dups.min_max(np.concatenate([np.unique(base), other]), np.array([0, 1000, 2000]))
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.08
    h, offs = near_dups.shingle_sets(pa.array(["a b c", None, "x", "A B C"]), 2)
    assert np.diff(offs).tolist() == [2, 0, 1, 2] and (h[:2] == h[3:]).all()


def substituted(n, k, ends):
    """Every pattern of n words of which k are substituted, at the ends too or not."""
    for out in combinations(range(n) if ends else range(1, n - 1), k):
        yield [i not in out for i in range(n)]


def is_hit(equal, masks):
    return any(all(equal[s + o] for o, c in enumerate(m) if c == "1") for m in masks for s in range(len(equal) - len(m) + 1))


def test_masks_hit_every_allowed_substitution():
    for n in range(12, 21):
        for k in range(n // 5 + 1):
            assert all(is_hit(e, decontaminate.MASKS) for e in substituted(n, k, False)), (n, k)
    for n in range(5, 12):
        for k in range(n // 5 + 1):
            assert all(is_hit(e, decontaminate.short_masks(n, 0.8)) for e in substituted(n, k, True)), (n, k)
    for n in range(6, 16):
        assert all(is_hit(e, decontaminate.long_masks(6, 0.7)) for e in substituted(n, n * 3 // 10, False))


def test_overlaps_of_short_items(spark):
    items = [(n, [f"s{n}x{i}" for i in range(n)]) for n in range(5, 12)]
    texts = {}
    for n, w in items:
        for out in combinations(range(n), n // 5 + 1):
            texts[len(texts)] = (n, 0, out, w)
        for out in combinations(range(n), n // 5):
            texts[len(texts)] = (n, n - len(out), out, w)
    docs = spark.createDataFrame([(i, " ".join(["lead", *("other" if j in out else x for j, x in enumerate(w)), "tail"])) for i, (_, _, out, w) in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    got = {r.doc_id: [tuple(o) for o in r.overlaps] for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert got == {i: [(n, 0, 1, n, m)] if m else [] for i, (n, m, _, _) in texts.items()}


def holds_overlap(equal, least=12, num=4, den=5):
    """Whether some stretch from an equal word to an equal word qualifies, by trying all."""
    sums = np.concatenate([[0], np.cumsum(equal)])
    return any(equal[a] and equal[b - 1] and den * (sums[b] - sums[a]) >= num * (b - a) for a in range(len(equal)) for b in range(a + least, len(equal) + 1))


def test_leak_beside_a_worse_region(spark):
    rng = np.random.default_rng(5)
    patterns = ["1" * 12 + "0101111" * 6, "1" * 20 + "1110" * 25, "1" * 10 + "01", "1" * 10 + "001", "1011111110" + "11", "111" + "0111" * 3]
    for n, share in ((30, 0.75), (60, 0.8), (120, 0.7), (40, 0.85)):
        patterns += ["".join("01"[int(x)] for x in rng.random(n) < share) for _ in range(60)]
    items = [(i, [f"p{i}x{j}" for j in range(len(p))]) for i, p in enumerate(patterns)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(["lead", *(x if c == "1" else "other" for x, c in zip(w, patterns[i], strict=True)), "tail"])) for i, w in items], "doc_id long, text string")
    rows = decontaminate.find_overlaps(docs, bench).collect()
    want = {}
    for i, p in enumerate(patterns):
        equal = np.array([c == "1" for c in p])
        want[i] = 5 * equal.sum() >= 4 * len(p) if len(p) <= 12 else holds_overlap(equal)
    assert {r.doc_id: bool(r.overlaps) for r in rows} == want and 60 < sum(want.values()) < len(want)
    for r in rows:
        for o in r.overlaps:
            assert o.length >= 12 and 5 * o.matches >= 4 * o.length and o.matches == patterns[r.doc_id][o.item_start : o.item_start + o.length].count("1")


@pytest.mark.parametrize("part_edges", [4, 1 << 19])
def test_components(spark, monkeypatch, part_edges):
    from tomeloom.llm import graph
    from tomeloom.llm._base import Scratch

    monkeypatch.setattr(graph, "PART_EDGES", part_edges)
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(20)] + [(100 + i, 100) for i in range(9)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (35, 2))] + [(7, 7)]
    least = {x: x for e in edges for x in e}
    while True:
        new = dict(least)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b], least[a], least[b])
        if new == least:
            break
        least = new
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), len(edges), Scratch(spark, "test"), "c").collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, y) for x, y in least.items() if x != y)


def test_shard_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (30, 5_000, 49, 0, 700, 120)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    shard = substrings.Shard(np.arange(len(texts)), offs, np.frombuffer(b"".join(texts), np.uint8), 50)
    valid = np.concatenate([np.arange(a, b - 49) for a, b in zip(offs[:-1], offs[1:], strict=True)])
    whole = shard.runs(), shard.string_keys(valid)
    monkeypatch.setattr(substrings, "_CHUNK", 256)
    cut = shard.runs(), shard.string_keys(valid)
    for found in (whole[0], cut[0]):
        assert (np.concatenate([np.arange(s, s + n) for s, n in zip(found.start, found.length, strict=True)]) == valid).all()
        assert (np.concatenate([np.arange(s, e) for s, e in zip(found.seg_start, found.seg_end, strict=True)]) == valid).all()
    keys = {}
    for runs, _ in (whole, cut):
        of = np.repeat(runs.key, runs.length)
        keys.setdefault("runs", of)
        assert (keys["runs"] == of).all()
    assert (whole[1].key == cut[1].key).all() and (whole[1].more == cut[1].more).all()
    strings = [shard.buf[i : i + 50].tobytes() for i in valid]
    assert len(set(strings)) == len(whole[1].distinct()) == len(set(whole[1].key.tolist()))
    repeat = np.zeros(len(shard.buf), bool)
    repeat[valid[::37]] = True
    want = np.zeros(len(shard.buf), bool)
    for i in valid[::37]:
        want[i : i + 50] = True
    assert (substrings._covered(repeat, 50) == want).all()


def test_ids_with_the_same_half():
    key, more = np.array([5, 3, 5, 5, 3, 9], np.uint64), np.array([2, 1, 1, 2, 1, 7], np.uint32)
    ids = substrings.Ids(key, more)
    found = ids.distinct()
    assert list(zip(found.key.tolist(), found.more.tolist(), strict=True)) == [(3, 1), (5, 1), (5, 2), (9, 7)]
    assert ids.among(found).tolist() == [2, 0, 1, 2, 0, 3]


def test_overlaps_of_any_rows(spark):
    item = " ".join(f"term{i}" for i in range(30))
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    rows = [(None, item, 1), (1, f"{long} {item} {long}", 1), (2, item, 1), (2, item, 1), (3, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = sorted(((r.doc_id, [tuple(o) for o in r.overlaps]) for r in decontaminate.find_overlaps(docs, bench).collect()), key=repr)
    assert got == sorted([(None, [(9, 0, 0, 30, 30)]), (1, [(9, 0, 200_000, 30, 30)]), *[(2, [(9, 0, 0, 30, 30)])] * 2, (3, [])], key=repr)
    with pytest.raises(ValueError):
        decontaminate.find_overlaps(docs.withColumnRenamed("key", "overlaps"), bench)


def test_line_dedup_of_an_empty_table(none):
    assert lines.remove_repeated_lines(none).count() == 0
