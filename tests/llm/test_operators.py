"""Each operator against a plain version of itself, over texts with copies, near copies, shared passages and odd cases."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import decontam, html_extract, langid, lm_score, mixing, parity_join, substring_dedup, suffix_dedup, warc, webp, webp_encode
from sparkloom.llm.common import Chunk, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, payload string, a string"


def texts():
    rng = random.Random(7)
    words = ["the", "of", "and", "été", "Ünder"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = line(60), line(150)
    out = [line(rng.randint(1, 120)) for _ in range(40)]
    out += [line(20) + " " + passage + "\n" + line(15) for _ in range(8)]
    for k in range(12):
        w = base.split()
        for _ in range(k // 3):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base] * 5 + [base.upper(), None, "", " \t\n", "a", "a b", "!!! 123", line(3000), passage + " " + passage, "é" * 80, "x" * 200]
    return list(enumerate(out, 3))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None, len(t or ""), i, "x", "y") for i, t in texts()]
    rows.append((None, "a text without a number", "en", "s0", 0, 1, "x", "y"))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_substring_dedup(docs, empty):
    seen, want = set(), {}
    for i, t in texts():
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = substring_dedup.dedup(docs)
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()}
    assert rows.pop(None)[1] == 0
    assert rows == want
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_of_repeated_rows(docs):
    want = {tuple(r) for r in substring_dedup.dedup(docs).collect()}
    twice = docs.union(docs)
    for parts in (twice.coalesce(1), twice.repartition(3)):
        got = [tuple(r) for r in substring_dedup.dedup(parts).collect()]
        assert set(got) == want and len(got) == 2 * docs.count()


def test_dedup_of_short_texts_and_many_slices(spark, monkeypatch):
    from sparkloom.llm import prefilter

    short = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (None, "a")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.dedup(short).collect()] == [0] * 4
    assert suffix_dedup.without_repeats(short, 50, lambda data, s, e: (len(s),), "n long", ("doc_id",)).where("found.n > 0").count() == 0
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 90)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substring_dedup.dedup(docs, 4).collect()))
    monkeypatch.setattr(prefilter, "SLICE_BITS", 11)
    assert sorted(map(tuple, substring_dedup.dedup(docs, 4).collect())) == want and any(r[2] for r in want)


def test_suffix_dedup(spark, docs, tmp_path):
    first, want = {}, {}
    for i, t in texts():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first.setdefault(b[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest())
    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.query(spark, str(tmp_path)).collect()}
    assert rows == want


@given(st.lists(st.text("ab", min_size=6, max_size=20), min_size=1, max_size=6), st.integers(3, 6))
@settings(max_examples=100, deadline=None)
def test_interval_expansion(segments, least):
    lengths = np.array([len(s) for s in segments])
    data = np.frombuffer("".join(segments).encode(), np.uint8)
    owners = np.arange(len(segments))
    segment, smallest = suffix_dedup.smallest_owner(lengths, data, owners, least)
    first = {}
    for k, s in enumerate(segments):
        for at in range(len(s) - least + 1):
            first.setdefault(s[at : at + least], k)
    assert smallest.tolist() == [first[s[at : at + least]] for s in segments for at in range(len(s) - least + 1)]


@pytest.mark.parametrize("size, percent, tile", [(4, 85, parity_join.TILE), (5, 80, 300)])
def test_ngram_join(docs, empty, size, percent, tile, monkeypatch):
    monkeypatch.setattr(parity_join, "TILE", tile)
    sets = {}
    for i, t in texts():
        w = low_words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and 100 * len(a & b) >= percent * len(a | b) > 0:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.link(docs, size, percent).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    if size == 4:
        assert parity_join.link(empty).count() == 0


def test_blocks_are_shared_by_common_shingles_only():
    """with 64 values for a block of one member, unrelated sets met by chance, the more often the more sets there are."""
    rng = np.random.default_rng(3)
    counts = np.full(600, 40)
    h = np.concatenate([np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64) << np.uint64(1)) for _ in counts])
    bands = parity_join.Bands(80, 100)
    k, d = bands.blocks(bands.of(counts))
    who, block, value, _ = parity_join.parity(h, np.cumsum(counts) - counts, counts, k, wide=True)
    assert len(set(zip(block.tolist(), value.tolist(), strict=True))) == len(who)
    assert (np.bincount(who) > d).all()  # so none sends its blocks without members, which many sets share


def test_join_of_large_groups(spark, monkeypatch):
    """sets that all hold one passage became one cluster of 319; those that can spare its groups stay out, and links are found."""
    monkeypatch.setattr(parity_join, "GROUP", 8)
    seen = []
    monkeypatch.setattr(parity_join, "tile_links", lambda docs, left, *a, real=parity_join.tile_links: (seen.append(left.groupBy("root").count().agg({"count": "max"}).first()[0]), real(docs, left, *a))[1])
    passage = [f"p{k}" for k in range(110)]
    rows = [(i, " ".join(passage + [f"d{i}x{k}" for k in range(120)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1].replace(f"d{i}x60", "new").replace(f"d{i}x90", "new")) for i in range(0, 300, 15)]
    got = {r["doc_id"]: r["component_id"] for r in parity_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert seen[0] < 160


def test_ties_of_a_large_group_are_linear():
    """a group of near copies gave all of its pairs; what pairs connect stays connected by fewer ties than nodes."""
    rng = np.random.default_rng(5)
    left, right = np.triu_indices(60, 1)
    a, b = np.concatenate([left, rng.integers(100, 400, 200)]), np.concatenate([right, rng.integers(100, 400, 200)])
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    need = np.where(np.arange(len(a)) % 5 == 4, 2, 1).astype(np.float32)  # of which the last are too few
    rows = [parity_join.pack(a, b, np.zeros(len(a), np.uint16), need, np.ones(len(a), np.int32))]
    got = parity_join.enough(pa.table({"payload": pa.array(rows, pa.binary())})).to_pylist()

    def parts(edges):
        home = {}
        for x, y in edges:
            both = home.get(x, {x}) | home.get(y, {y})
            home |= dict.fromkeys(both, both)
        return {frozenset(p) for p in home.values()}

    least = {}
    for x, y, n in zip(a.tolist(), b.tolist(), need.tolist(), strict=True):
        least[x, y] = (least.get((x, y), (9, 0))[0], least.get((x, y), (9, 0))[1] + 1) if (x, y) in least and least[x, y][0] <= n else (n, least.get((x, y), (9, 0))[1] + 1)
    want = parts(e for e, (n, times) in least.items() if times >= n)
    assert parts((r["a"], r["b"]) for r in got) == want
    assert len(got) == sum(len(p) - 1 for p in want)


def test_join_stage_of_repeated_and_null_doc_ids(spark):
    text = lambda name, *changed: " ".join("new" if k in changed else f"{name}{k}" for k in range(60))
    rows = [
        (1, text("a")), (1, text("a")), (2, text("a", 5)), (2, text("b")), (3, text("b", 7)), (3, text("c")), (4, text("d")), (4, text("d", 9)),
        (5, text("e")), (5, text("a")), (6, None), (6, ""), (7, None), (None, text("a")), (None, text("a")), (None, None),
    ]
    shingles = {t: {tuple((t or "").split()[k : k + 5]) for k in range(56)} if t else set() for _, t in rows}
    groups = []
    for i, t in sorted({r for r in rows if r[0] is not None and r[1]}):
        near = [g for g in groups if any(100 * len(shingles[t] & shingles[u]) >= 80 * len(shingles[t] | shingles[u]) for _, u in g)]
        groups = [g for g in groups if g not in near] + [[(i, t), *(x for g in near for x in g)]]
    least = [{(i, t) for i, t in g if i == min(g)[0]} for g in groups]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, source string").repartition(3)
    got = parity_join.stage(spark, docs, "")
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    words = [r for r in got if r[0] is not None and r[1]]
    assert len(words) == len(least) and all(len(g & set(words)) == 1 for g in least)
    assert [r[0] for r in got if not r[1]].count(6) == [r[0] for r in got if not r[1]].count(7) == 1
    assert sorted(map(str, (t for i, t in got if i is None))) == sorted(map(str, (t for i, t in rows if i is None)))


@given(st.integers(0, 10**6), st.sampled_from([80, 85]))
@settings(max_examples=60, deadline=None)
def test_forest_connects_all_links(seed, percent):
    rng = random.Random(seed)
    bases = [rng.sample(range(1000), rng.randint(5, 40)) for _ in range(3)]
    sets = sorted({tuple(sorted({x if rng.random() > 0.07 else rng.randrange(1000) for x in rng.choice(bases)})) for _ in range(40)})
    arrays = [np.sort(parity_join.mix(np.array(s, np.uint64) + np.uint64(1))) for s in sets]
    ids = np.arange(len(sets))

    def groups(edges):
        label = list(ids)
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    links = [(i, j) for i in ids for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))]
    assert groups(parity_join.Forest(ids, arrays, percent).build()) == groups(links)
    side = np.array([rng.randrange(2) for _ in ids])
    found = parity_join.Forest(ids, arrays, percent).build(side)
    assert groups(found) == groups([(i, j) for i, j in links if side[i] != side[j]])


def test_join_of_large_clusters_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "TILE", 400)
    rng = random.Random(5)
    chain = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):  # a chain of near copies whose ends are far apart, and one group around its first
        rows.append((k, " ".join(chain)))
        for _ in range(12 if k == 30 else 1):
            chain[rng.randrange(60)] = f"x{k}"
    first = rows[0][1].split()
    rows += [(100 + k, " ".join(first[:30] + [f"y{k}"] + first[31:])) for k in range(40)]
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(57)} for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    got = {r["doc_id"]: r["component_id"] for r in parity_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label and len(set(label.values())) == 2


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 51), (50, 51)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {**dict.fromkeys(range(1, 41), 1), 50: 50, 51: 50}


def test_language_id(docs):
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    rows = [(make(["the", "ing", "ow"]), "en") for _ in range(60)] + [(make(["eau", "é", "oi"]), "fr") for _ in range(60)]
    model = langid.fit(rows)
    names, score, ok = langid.predict(model, [make(["the", "ing", "ow"]), make(["eau", "é", "oi"]), None, "12 !!", ""])
    assert names == ["en", "fr", "und", "und", "und"] and ok.tolist() == [True, True, False, False, False]
    assert all(0 <= s <= 1 for s in score) and langid.fit([]).labels == []
    assert langid.identify(docs, langid.fit([]), ("doc_id",)).where("lang_pred <> 'und' or accepted").count() == 0


def test_decontamination(spark, docs, empty):
    have = dict(texts())
    items = [(1, have[50]), (2, "a b"), (3, None), (4, " ".join(low_words(have[44])[22:60])), (5, "nothing of this is anywhere at all in them")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    shingle = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    for k, t in items:
        w = low_words(t)
        n = min(5, len(w))
        for i, text in have.items():
            d = low_words(text)
            goal = Counter(shingle(w, n)) if w else Counter()
            best = max((sum((goal & (c := Counter(shingle(d[s : s + len(w)], n)))).values()) / sum((goal | c).values()) for s in range(len(d) - len(w) + 1)), default=0) if w else 0
            if best >= 0.8:
                want.add((i, k))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.found(docs, bench).collect()}
    assert got == want and len({k for _, k in want}) == 3
    assert decontam.found(empty, bench).count() == 0


def test_decontamination_at_the_edges(spark):
    item = [f"i{k}" for k in range(40)]
    other = [f"o{k}" for k in range(30)]
    rows = {
        1: other + item[:-1], 2: other + item[:-3], 3: item[1:] + other, 4: item[3:] + other, 5: item[:-1], 6: item[2:-2],
        7: item[:20] + item[21:], 8: other + item[:20] + item[21:], 9: item[:32], 10: other + item[:20] + other, 11: item[:-1] + other, 12: item[:20], 13: item[:33],
    }
    want = {}
    shingle = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for i, d in rows.items():
        sims = [sum((shingle(item) & (c := shingle(d[s : s + 40]))).values()) / sum((shingle(item) | c).values()) for s in range(max(1, len(d) - 39))]
        if max(sims) >= 0.8:
            want[i] = (sims.index(max(sims)), pytest.approx(max(sims)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["similarity"]) for r in decontam.found(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == want and {1, 3, 5} <= set(want) and not {10, 12} & set(want)


def test_mixing(docs, empty):
    got = mixing.mix(docs, repeats=2.0).select("doc_id", "source", "tokens", "copies").collect()
    total, seen = Counter(), Counter()
    for r in got:
        total[r["source"]] += r["tokens"]
        seen[r["source"]] += r["tokens"] * r["copies"]
    assert len(got) == docs.count() and all(seen[s] <= 2 * total[s] for s in total)
    assert any(seen[s] > 1.2 * total[s] for s in total)
    assert mixing.mix(empty).count() == 0
    sources = docs.sparkSession.createDataFrame([("a", 1000), ("b", 10)], "source string, tokens long")
    w = {r["source"]: r["weight"] for r in mixing.weights(sources, None, 0.5).collect()}
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.5, abs=1e-6)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="ad">buy this now and much more of it please</div><article><h1>Head &amp;  line</h1><p>One <b>bo</b>ld  para<p>Two &lt;x&gt; &eacute;</p><div id="comments">a reader says so</div></article><footer>&copy; foot</footer></body></html>"""


def test_html():
    costs = html_extract.learn([PAGE] * 3)
    assert html_extract.extract(PAGE, costs) == "Head & line One bold para Two <x> é"
    assert html_extract.extract(PAGE, dict(html_extract.DEFAULT_COSTS)) == "Head & line One bold para Two <x> é"
    assert html_extract.extract(None, costs) == html_extract.extract("", costs) == html_extract.extract("<nav>x", costs) == ""
    assert html_extract.extract("<nav>x<article><p>body", costs) == "body"


def test_warc():
    raw = warc.response(1, "http://e.org/", PAGE)
    meta, text = warc.derive(raw)
    assert (meta[0], text[0]) == ("metadata", "conversion") and meta[2] == text[2] and meta[1] != text[1]
    fields, block = warc.parse(text[8])
    assert fields["warc-refers-to"] == text[2] and fields["warc-block-digest"] == warc.digest(block) and fields["warc-refers-to-target-uri"] == "http://e.org/"
    assert b"outlink: /x" in meta[8] and b"title: T" in meta[8] and meta[5]
    assert warc.derive(None) == warc.derive(b"junk") == []
    assert not warc.derive(raw.replace(b"foot", b"f00t"))[0][5]


@given(st.binary(max_size=600))
@settings(max_examples=60, deadline=None)
def test_webp_round_trip(data):
    payload = webp.padded(data)
    assert np.ascontiguousarray(webp.decode(webp.encode(payload))[..., :3]).tobytes() == payload


def test_webp_codes_follow_the_image(monkeypatch):
    """what is read depends on prefix codes of several lengths; blocks of bits give what symbols one by one give."""
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("etaoinshrdlu", range(12, 0, -1), k=rng.randint(1, 9))) for _ in range(40000)).encode()
    for data in (text, text[:500], bytes(range(256)) * 9, b"ab" * 5000, bytes(rng.choices(range(256), [1.5**-k for k in range(256)], k=9000))):
        payload = webp.padded(data)
        media = webp.encode(payload)
        got = webp.decode(media)
        assert np.ascontiguousarray(got[..., :3]).tobytes() == payload
    assert len(webp.encode(webp.padded(text))) < 0.6 * len(text)
    seen = []
    monkeypatch.setattr(webp, "literals", lambda bits, codes, total: seen.append([sorted({n for n in c.lengths if n}) for c in codes]) or np.array([[c.read(bits) for c in codes] for _ in range(total)], np.uint32).T)
    assert np.ascontiguousarray(webp.decode(webp.encode(webp.padded(text[:3000])))[..., :3]).tobytes() == webp.padded(text[:3000])
    assert all(len(sizes) > 2 for sizes in seen[0])


def written(width, height, put):
    w = webp.Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    put(w)
    chunk = w.value.to_bytes((w.n + 7) // 8 + 4, "little")
    chunk += b"\0" * (len(chunk) & 1)
    return b"RIFF" + (12 + len(chunk)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk


def one_colour(w, a, r, g, b):
    """An image of one colour: five codes of one symbol each."""
    for value in (g, r, b, a):
        w.put(0b101 | value << 3, 11)
    w.put(0b0001, 4)


def test_webp_transforms():
    def put(w):
        w.put(1, 1)
        w.put(2, 2)  # subtract green
        w.put(1, 1)
        w.put(0, 2)  # predictor, tiles of four
        w.put(0, 3)
        w.put(0, 1)
        one_colour(w, 255, 0, 1, 0)  # mode 1: the pixel to the left
        w.put(0, 1)
        w.put(0, 2)  # no cache, one group
        one_colour(w, 0, 1, 2, 3)

    got = webp.decode(written(3, 2, put))
    x = np.array([[1, 2, 3], [2, 3, 4]])
    assert (got[..., 1] == 2 * x).all() and (got[..., 0] == 3 * x).all() and (got[..., 2] == 5 * x).all() and (got[..., 3] == 255).all()


def test_webp_references_and_cache():
    def put(w):
        w.put(0, 1)
        w.put(1 | 1 << 1, 5)  # a cache of two colours
        w.put(0, 1)
        # green: literal 20 and length code 256 + 3 (a length of four), as a normal code of 282 symbols
        lengths = [0] * 282
        lengths[20] = lengths[259] = 1
        w.put(0, 1)
        w.put(0, 4)  # code length codes 17, 18, 0 and 1
        for n in (0, 1, 0, 1):
            w.put(n, 3)
        w.put(0, 1)
        at = 0
        while at < 282:  # symbol 1 is the bit 0, symbol 18 the bit 1
            if lengths[at]:
                w.put(0, 1)
                at += 1
            else:
                run = next((k for k in range(at, 282) if lengths[k]), 282) - at
                step = min(138, run)
                step = run - 11 if 0 < run - step < 11 else step
                w.put(1, 1)
                w.put(step - 11, 7)
                at += step
        for value in (9, 8, 255):
            w.put(0b101 | value << 3, 11)
        w.put(0b101 | 1 << 3, 11)  # distance code 1 -> 2: the pixel to the left
        w.put(0b10, 2)  # literal, then the reference

    got = webp.decode(written(5, 1, put))
    assert (got[0] == np.array([9, 20, 8, 255])).all()


def webp_payloads():
    """name -> payload, each of which is shorter by what it is named after."""
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:48, :64]
    noise = lambda size, top: rng.integers(0, top, (48, 64, size))
    grey, strong = noise(1, 256), noise(1, 200).astype(np.uint8).view(np.int8).astype(np.int64)
    many = rng.integers(0, 256, (400, 3))
    out = {
        "predictor": np.stack([x * 3 + y, x + y * 2, 255 - x - y], axis=-1) + noise(3, 3),
        "green": grey + noise(3, 2),
        "cross": np.concatenate([strong * 20 >> 5, strong, strong * -25 >> 5], axis=-1) + noise(3, 2) * [1, 0, 1],
        "repeats": np.tile(noise(3, 256)[:12], (4, 1, 1)),
        "cache": many[np.minimum(rng.geometric(0.01, (48, 64)), 400) - 1],
        "groups": np.concatenate([rng.integers(0, 8, (128, 64, 3)), rng.integers(100, 256, (128, 64, 3))]),
    }
    for colours in (2, 4, 16, 200):
        out[f"palette {colours}"] = many[rng.integers(0, colours, (48, 64))]
    return {k: v.astype(np.uint8).tobytes() for k, v in out.items()}


def webp_seen(monkeypatch):
    """What the decoder meets, as it meets it."""
    seen = {"predictor": 0, "cross": 0, "green": 0, "palette": set(), "repeats": 0, "cache": 0, "groups": 0}

    def count(name, of):
        f = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a: of(*a) or f(*a))

    count("undo_predictor", lambda c, modes, tile: seen.update(predictor=seen["predictor"] + 1))
    count("undo_cross_colour", lambda *a: seen.update(cross=seen["cross"] + 1))
    count("told_pixels", lambda told, *a: seen.update(repeats=seen["repeats"] + int(((told[0] >= 256) & (told[0] < 280)).sum()), cache=seen["cache"] + int((told[0] >= 280).sum())))
    count("symbols", lambda bits, codes, *a: seen.update(groups=max(seen["groups"], len(codes))))
    return seen


def test_webp_writes_by_each_part_of_the_method(monkeypatch):
    """transforms, repetitions, the cache and groups of codes are written where they are shorter, and read back."""
    seen = webp_seen(monkeypatch)
    for name, payload in webp_payloads().items():
        before = dict(seen)
        media = webp.encode(payload)
        back = webp.decode(media)
        assert np.ascontiguousarray(back[..., :3]).tobytes() == payload, name
        if name in ("predictor", "cross", "repeats", "cache"):
            assert seen[name] > before[name], name
        first = webp.Bits(media[20:])
        first.read(40)
        if name.startswith("palette"):
            assert (first.read(3), first.read(8) + 1) == (0b111, int(name.split()[1]))
        if name == "green":
            assert first.read(3) == 0b101
        with monkeypatch.context() as m:  # symbol by symbol
            m.setattr(webp, "FEW", 1 << 30)
            assert (webp.decode(media) == back).all(), name
    assert seen["groups"] == 2


def test_webp_texts_repeat_and_are_coded_alone(monkeypatch):
    """words of texts are told by repetitions and the cache; an image doesn't depend on those written with it."""
    seen = webp_seen(monkeypatch)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    payloads = [webp.padded((t or "").encode()) for _, t in texts()] + [webp.padded(" ".join(rng.choice(words) for _ in range(n)).encode()) for n in (900, 30000)]
    together = webp.encode_all(payloads)
    assert together == [webp.encode(p) for p in payloads]
    for payload, media in zip(payloads, together, strict=True):
        back = webp.decode(media)
        assert np.ascontiguousarray(back[..., :3]).tobytes() == payload
        with monkeypatch.context() as m:
            m.setattr(webp, "FEW", 1 << 30)
            assert (webp.decode(media) == back).all()
    assert seen["repeats"] > 100 and seen["cache"] > 100


def test_webp_predictor_modes():
    rng = np.random.default_rng(4)
    px = np.clip(rng.integers(0, 256, (40, 64, 3)) // rng.choice([1, 20], (40, 64, 1)), 0, 255).astype(np.uint8)
    expected = webp_encode.guesses(px, np.array([0]))
    for modes in [np.full((3, 4), m) for m in range(14)] + [rng.integers(0, 14, (3, 4)) for _ in range(4)]:
        per = np.repeat(np.repeat(modes, 16, axis=0), 16, axis=1)[:40]
        guess = expected[per, np.arange(40)[:, None], np.arange(64)]
        guess[:, 0] = expected[2][:, 0]
        guess[0] = expected[1][0]
        rest = np.concatenate([np.zeros((40, 64, 1), np.int32), (px - guess).astype(np.int32)], axis=-1)
        assert (webp.undo_predictor(rest, modes, 4)[..., 1:] == px).all()


def test_webp_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in webp.query(spark, str(tmp_path)).collect()}
    for i, t in texts():
        payload = webp.padded((t or "").encode())
        media = webp.encode(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())


def test_webp_rejects(spark):
    rows = spark.createDataFrame([(1, bytearray(webp.encode(webp.padded(b"hi")))), (2, bytearray(b"RIFFxx")), (3, None)], "id long, media binary")
    assert {r["id"]: r["height"] for r in webp.pixels(rows, keep=("id",)).collect()} == {1: 1, 2: None, 3: None}


def test_lm_scores(docs, empty):
    got = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    words = {i: [*low_words(t), None] for i, t in texts()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n = sum(c.values())
    bottom = math.log10(n + 0.1 * (len(c) + 1))
    assert set(got) == set(words)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(c[w] + 0.1) - bottom for w in ws))
        assert r["score"] < 0
    assert lm_score.score(empty).count() == 0


def test_lm_counts_are_those_of_all_training_documents(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "SAMPLE_DOCS", 8)
    monkeypatch.setattr(lm_score, "CHECK_DOCS", 2)
    fit, made = lm_score.fit, []
    monkeypatch.setattr(lm_score, "fit", lambda *a, **b: made.append(fit(*a, **b, steps=5)) or made[-1])
    assert lm_score.score(docs).count() == len(texts())
    model = made[0]
    model.ready()
    n = len(model.cls)
    units, heads, pairs = Counter(), Counter(), Counter()
    for i, t in texts():
        if zlib.crc32(str(i).encode()) % 10:
            for u in model.units_of([w.encode() for w in low_words(t)]):
                units.update(u.tolist())
                heads[u[0]] += 1
                pairs.update(zip(u[:-1].tolist(), u[1:].tolist(), strict=True))
            units[n - 1] += 1
    c = np.array([units[k] + 0.05 for k in range(n)])
    assert model.inside == pytest.approx(np.log10(c / np.bincount(model.cls, c)[model.cls]), abs=1e-4)
    assert model.totals == pytest.approx(np.bincount(model.cls, [heads[k] for k in range(n)], lm_score.CLASSES))
    of_class = Counter()
    for (a, b), k in pairs.items():
        of_class[a, model.cls[b]] += k
    for (a, b), k in pairs.items():
        want = (k / 10.0 ** model.inside[b] + lm_score.PRIOR) / (of_class[a, model.cls[b]] + lm_score.PRIOR)
        assert model.inner_logs(np.array([a]), np.array([b]))[0] == pytest.approx(math.log10(want), abs=1e-4)
    assert len(model.pairs[0]) == len(pairs) > 0


def test_lm_weights_follow_every_training_document(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SAMPLE_DOCS", 8)
    monkeypatch.setattr(lm_score, "CHECK_DOCS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "tree", "house", "river"], 60))) for i in range(60)]
    # learned from, but not among those that the weights start from: the same words in another order leave all counts as they are
    late = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 and zlib.crc32(f"lm{i}".encode()) % 6}
    other = [(i, " ".join(sorted(t.split())) if i in late else t) for i, t in rows]
    a, b = ({r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, other))
    held = [i for i, _ in rows if a[i]["held_out"]]
    assert held
    for i in held:
        assert a[i]["base_score"] == pytest.approx(b[i]["base_score"])
        assert abs(a[i]["score"] - b[i]["score"]) > 1e-3


def test_lm_gradients():
    rng = np.random.default_rng(1)
    model = lm_score.fit({bytes([b]): b for b in range(256)}, [b" ".join(bytes(rng.integers(97, 103, 3).astype(np.uint8)) for _ in range(150)), b""], steps=5)
    streams = lm_score.streams_of(model, [b"abc dab " * 9, b"a"])
    units, sizes = np.concatenate(streams).astype(np.int64), np.array([len(x) for x in streams])
    descent = lm_score.Descent(model.weights)
    descent.step(*lm_score.lessons(model, units, sizes), 0.0)
    start = model.weights
    for name, (mean, _) in descent.moment.items():
        at = np.unravel_index(np.abs(mean).argmax(), mean.shape)
        losses = []
        for move in (0.01, -0.01):
            model.weights = {k: w.copy() for k, w in start.items()}
            model.weights[name][at] += move
            model.ready()
            losses.append(-float((lm_score.unit_logs(model, units, sizes) - model.inside[units]).astype(float).mean()) * math.log(10))
        assert 10 * mean[at] == pytest.approx((losses[0] - losses[1]) / 0.02, rel=0.02)


def test_units_are_a_distribution():
    model = lm_score.fit({bytes([b]): b for b in range(256)}, [b"a b a", b"b a"], steps=5)
    prefix = model.units_of([b"a"])[0]
    total = 0.0
    for u in range(len(model.cls)):
        stream = np.array([*prefix, u], np.int64)
        total += 10 ** float(lm_score.unit_logs(model, stream, np.array([len(stream)]))[-1])
    assert total == pytest.approx(1.0, abs=1e-3)


def test_inner_units_are_a_distribution():
    model = lm_score.fit({bytes([b]): b for b in range(256)}, [b" ".join(bytes([x, y]) for x in range(97, 123) for y in range(97, 123) if (7 * x + y) % 5 == 0)], steps=5)
    units = np.arange(len(model.cls))
    for before in (model.units_of([b"ab"])[0][1], model.units_of([b"q?"])[0][0]):
        plain = 10 ** model.inside.astype(float)
        inner = plain * 10 ** model.inner_logs(np.full(len(units), before), units)
        assert np.bincount(model.cls, inner) == pytest.approx(np.bincount(model.cls, plain), abs=1e-3)
    gains = [model.inner_logs(u[1:2], u[2:3])[0] for u in (model.units_of([bytes([x, y])])[0] for x in range(97, 123) for y in range(97, 123) if (7 * x + y) % 5 == 0)]
    assert min(gains) > -1e-6 and max(gains) > 0.1


def test_units_of_many_words_are_those_of_each():
    ranks = {bytes([b]): b for b in range(256)} | {b" a": 256, b"ab": 257, b" ab": 258, "é".encode(): 259}
    model = lm_score.fit(ranks, [b"ab a b", b"b a"], steps=2)
    words = [b"a", b"abab", "é é".encode(), b"\x1cab", b"b", b"\xff"]
    for word, units in zip(words, model.units_of(words), strict=True):
        assert units.tolist() == model.units_of([word])[0].tolist()
        assert (units % 2).tolist() == [0] * (len(units) - 1) + [1]
    assert model.units_of([]) == []


def some_texts(n):
    rng = random.Random(9)
    return [" ".join("".join(rng.choice("abcdEfé") for _ in range(rng.randint(2, 7))) + rng.choice(["", "\u00a0x", "\n"]) for _ in range(n)).encode() for _ in range(6)] + [b"", b"caf\xe9 \xff b", b"\t \n"]


def test_cuts_are_packed_and_give_the_units_of_each_word(monkeypatch):
    monkeypatch.setattr(lm_score, "CACHE", 300)  # so that known words are forgotten in between
    model = lm_score.blank(lm_score.read_ranks(lm_score.TOKENIZER))
    model.ready()
    fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    for k, text in enumerate(some_texts(200) * 2):
        docs = lm_score.cut(model, Chunk(np.array([k, k + 50]), [text, b"Ab " + text]), 10)
        back = lm_score.Cut.read(pa.scalar(docs.packed(), pa.binary()))
        for name in ("ids", "held", "words", "which", "hashes", "lengths", "flat"):
            assert getattr(back, name).dtype == getattr(docs, name).dtype
            assert getattr(back, name).tolist() == getattr(docs, name).tolist()
        stream = lm_score.laid(model.end, back)[0].tolist()
        assert stream == np.concatenate(lm_score.streams_of(model, [x.translate(fold) for x in (text, b"Ab " + text)])).tolist()


def test_known_words_take_little_memory():
    """a worker held an array and a number for each word that it knew."""
    model = lm_score.blank(lm_score.read_ranks(lm_score.TOKENIZER))
    model.ready()
    lm_score.cut(model, Chunk(np.arange(1), [b"a"]), 10)  # tables of powers are made once
    chunk = Chunk(np.arange(9), some_texts(8000))
    tracemalloc.start()
    try:
        docs = lm_score.cut(model, chunk, 10)
        words = len(docs.hashes)
        del docs
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert words > 20_000
    assert held < 60 * words


def test_lm_scoring_works_in_bounded_batches(spark):
    """F1: whole files of text went through an executor as one batch each; scores are those of larger batches."""
    from sparkloom.llm import common

    def rows(session):
        return sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in lm_score.score(session.createDataFrame(texts(), "doc_id long, text string").coalesce(1)).collect())

    small = spark.newSession()
    small.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2000")
    wide = spark.newSession()
    bounds = lambda session: (session._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch(), session._jsparkSession.sessionState().conf().parquetVectorizedReaderBatchSize())
    assert bounds(wide) > (common.ARROW_BYTES, common.SCAN_ROWS)
    want = rows(wide)
    assert bounds(wide) == (common.ARROW_BYTES, common.SCAN_ROWS)
    got = rows(small)
    assert bounds(small) == (2000, common.SCAN_ROWS)  # a lower setting stays
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-5)


def test_lm_parts_are_row_groups_of_their_own(spark, monkeypatch):
    """the parts of a task, 4 MB of text each, were written and read as one row group, all in an executor's memory."""
    class Written(Exception):
        pass

    def first(df, *a, **b):
        raise Written(checkpointed(df, *a, **b).inputFiles())

    checkpointed = lm_score.checkpointed
    monkeypatch.setattr(lm_score, "checkpointed", first)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 90_000).tolist())) for i in range(10)]
    with pytest.raises(Written) as written:
        lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    found = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written.value.args[0]]
    assert [m.num_row_groups for m in found] == [m.num_rows for m in found]
    assert sum(m.num_rows for m in found) > 1


CLASHES = ["score", "accepted", "lang_pred", "__text", "text_", "kept", "kept_text", "__id", "__runs", "g", "id", "found", "copies", "tokens", "s", "b", "n", "c1", "root", "rep", "component", "first", "left", "passes", "bucket"]


def test_pipeline_with_clashing_names_against_its_rules(spark, tmp_path):
    """run() over odd rows and columns: what each stage must keep and drop, by plain Python."""
    import corpus_pipeline

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [line(40), line(30)]
    base, passage = line(120), line(30)
    rows = [line(rng.randint(60, 150)) for _ in range(60)]
    rows += [base, base, base + " and more", "x " + base]
    rows += [line(60) + " " + passage + " " + line(50) for _ in range(4)]
    rows += [line(40) + " " + items[0] + " " + line(40), items[1] + " " + line(80)]
    rows += [None, "", "12345 !!", line(4000)]
    table = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("own").alias(c) for c in CLASHES])
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {*docs.columns, "tokens", "copies"}
    got = {r["doc_id"]: r for r in out.collect()}
    copies = set(range(60, 64))
    assert len(copies & set(got)) == 1 and min(copies) in got  # near copies: the smallest doc_id
    assert not {68, 69} & set(got)  # benchmark passages
    assert not {70, 71, 72} & set(got)  # no language
    assert set(range(60)) | {64, 73} <= set(got)  # clean documents stay
    first, want = {}, {}
    for i in sorted(set(range(60)) | {60, 64, 65, 66, 67, 73}):  # what reaches the third stage
        b = rows[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first.setdefault(b[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        want[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode()
    for i, r in got.items():
        assert r["text"] == want[i] and r["n_chars"] == len(want[i]) and r["tokens"] == len(want[i].split()) and r["copies"] >= 1
        assert all(r[c] == "own" for c in CLASHES if c not in ("tokens", "copies"))
    assert len(want[65]) < len(rows[65])


@pytest.mark.parametrize("stage", [0, 1, 2])
def test_pipeline_stages_work_in_bounded_batches(spark, docs, tmp_path, monkeypatch, stage):
    """whole files of text went through an executor as one batch each; rows are the same however small the batches."""
    import corpus_pipeline
    from sparkloom.llm import common

    def rows(session, path):
        return sorted(map(str, corpus_pipeline.STAGES[stage][1](session, session.read.parquet(path), "").collect()))

    def most(session, path):
        sizes = session.read.parquet(path).select("doc_id", "text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        return max(r["n"] for r in sizes.collect())

    wide, odd = str(tmp_path / "wide"), str(tmp_path / "odd")
    spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat('t', id, repeat(' word', 800)) AS text", "'en' AS lang", "4000 AS n_chars").write.parquet(wide)
    docs.write.parquet(odd)
    session = spark.newSession()
    assert most(session, wide) > 10e6
    want = rows(session, odd)
    assert most(session, wide) < common.ARROW_BYTES + 10_000  # up to the row that goes beyond
    monkeypatch.setattr(common, "ARROW_BYTES", 2000)
    monkeypatch.setattr(common, "SCAN_ROWS", 8)
    small = spark.newSession()
    assert rows(small, odd) == want
    assert most(small, wide) < 10_000


def test_bytes_that_are_no_utf8(spark):
    bad = spark.createDataFrame([(1, bytearray(b"caf\xe9 \xff\xfe words")), (2, None)], "doc_id long, raw binary")
    docs = bad.selectExpr("doc_id", "doc_id AS page_id", "'http://e.org/' AS url", "CAST(raw AS STRING) AS text", "CAST(raw AS STRING) AS html", "'s' AS source", "'en' AS lang")
    assert langid.identify(docs, langid.fit([("some words here", "en"), ("des mots ici", "fr")]), ("doc_id",)).count() == 2
    assert html_extract.main_text(docs, dict(html_extract.DEFAULT_COSTS)).count() == 2
    assert warc.responses(docs).count() == 2
    assert substring_dedup.dedup(docs).count() == mixing.mix(docs).count() == 2
