"""SimHash classes and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from threatlake.llm import simhash, spelling
from threatlake.llm.common import heavy_lookup, table
from threatlake.llm.components import connected
from threatlake.llm.queries import op11_simhash, op12_spelling

SPACES = " \t\n\x0b\x0c\r"


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _print(text, words=4):
    own = [w for w in re.split(f"[{SPACES}]+", _lower(text)) if w]
    shingles = [" ".join(own[k:k + words]) for k in range(len(own) - words + 1)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints, radius=4):
    """For each fingerprint the smallest of those that links lead to."""
    prints, root = sorted(prints), {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = np.array(prints, np.uint64)
    for k, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(every[k + 1:] ^ every[k]) <= radius).tolist():
            a, b = find(p), find(prints[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def _simhash(rows):
    prints = [_print(t) for _, t in rows]
    classes, least = _classes(set(prints)), {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[classes[p]] = min(i, least.get(classes[p], i))
    return Counter((i, f"{p:016x}", least.get(classes[p])) for (i, _), p in zip(rows, prints))


def test_simhash_components(odd_docs, odd_rows, no_docs):
    rows = [(i, t) for i, t, _ in odd_rows]
    assert Counter(map(tuple, simhash.simhash_components(odd_docs).collect())) == _simhash(rows)
    assert simhash.simhash_components(no_docs).count() == 0


def test_simhash_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = Counter(map(tuple, op11_simhash(spark, sf_dir).collect()))
    assert found == _simhash(rows)
    assert len({c for _, _, c in found}) < len({p for _, p, _ in found})


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"W{k % 91} \t é{k % 7}" for k in range(400))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 17)
    assert simhash.fingerprint(text) == whole
    assert whole % (1 << 64) == _print(text)


def test_near_links(spark, monkeypatch):
    """Random balls and a chain of many fingerprints, in small blocks and slices."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 64)
    monkeypatch.setattr(simhash, "SLICE", 256)
    monkeypatch.setattr(simhash, "PENDING", 20)
    rng = random.Random(7)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << b
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed.values()], "print bigint"), 4)
    roots = {r.node: r.root for r in connected(links).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for p, root in _classes(prints).items():
        wanted[root].add(p)
        groups[roots.get(signed[p], signed[p])].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_buckets():
    """A bucket holds a small part of all fingerprints at any number of them, and all masks have one."""
    for n in (10, 10**6, 10**9, 10**11):
        ball = simhash.Ball(2, groups := simhash.groups_for(n, 2))
        assert n * len(ball.shifts) <= simhash.BUCKET_ROWS << groups
        assert sum(map(len, ball.masks.values())) == 1 + 64 + 64 * 63 // 2


def test_heavy_lookup(spark):
    rows = spark.createDataFrame([(k if k % 3 else 0,) for k in range(6000)], "k bigint")
    held = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 as twice")
    found = heavy_lookup(rows, held.where("k % 5 <> 1"), "k", 6000, how="left")
    assert Counter(map(tuple, found.collect())) == Counter((k, None if k % 5 == 1 else 2 * k) for k in (k if k % 3 else 0 for k in range(6000)))


def _spelling(rows, least=7, min_count=2, factor=10):
    counts = Counter()
    for i, text in rows:
        for word in re.findall("[a-zÀ-ÿ]+", _lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            if len(word) >= least:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    letters, near = sorted(set("".join(counts))), {}
    for w in counts:
        others = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k + e:] for k in range(len(w) + 1) for c in letters for e in (0, 1)}
        near[w] = sorted(x for x in others if x in counts and x != w)
    best = {w: min(own, key=lambda x: (-counts[x], x)) for w, own in near.items() if own}
    form = {w: x for w, x in best.items() if counts[x] >= factor * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def _rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    wanted = _spelling(rows)
    assert _rows_of(op12_spelling(spark, sf_dir)) == wanted
    assert any(f for _, f, *_ in wanted) and any(n == 0 for *_, n, _ in wanted)


def test_spelling_of_odd_texts(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(spelling, "NODE_WORDS", 4)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 7)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    monkeypatch.setattr(spelling, "FEW", 2)
    chain = "abcdefghij " * 1000 + "abcdefghi " * 90 + "abcdefgi " * 8 + "abcdegix " * 8 + "abcdefghi÷ " * 9 + "hgfedcba " * 3 + "É" * 90 + " " + "É" * 91 + " "
    extra = [(5, chain, None), (6, chain.upper(), None), (7, "ABCDEFGé×abcdefgÉ 7abcdefg8" * 2, None)]
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t, _ in extra], "doc_id bigint, text string"))
    wanted = _spelling([(i, t) for i, t, _ in [*odd_rows, *extra]])
    assert _rows_of(spelling.spelling_groups(df)) == wanted
    assert len({r for _, f, r, *_ in wanted if f and f != r}) > 0
    assert spelling.spelling_groups(no_docs).count() == 0


def test_pieces_keep_runs_whole(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE_POINTS", 3)
    text = "abcdefghij x É÷éa 12 中文abcdefgh"
    assert "".join(spelling._pieces(text)) == text
    assert [w for p in spelling._pieces(text) for w in re.findall("[a-zÀ-ÿ]+", p)] == re.findall("[a-zÀ-ÿ]+", text)


def test_one_edit():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(150)})
    near = {w: {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k + e:] for k in range(len(w) + 1) for c in "abc" for e in (0, 1)} - {w} for w in words}
    coded = spelling.Coded(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    wanted = [words[b] in near[words[a]] for a, b in zip(i, j)]
    assert spelling._verified(coded, coded, i, j).tolist() == wanted
    assert [spelling.one_edit(words[a], words[b]) for a, b in zip(i, j)] == wanted
