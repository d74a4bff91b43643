"""Shards, mixing, suffix tree, WARC and the pipeline."""

import collections
import gzip
import hashlib
import io
import math
import zlib

import numpy as np
import pytest

from plumbline.llm import mixing, shards, suffix_tree, warc


def rows_of(n, source=lambda i: f"s{i % 5}"):
    return [(i, ("word " * (i * 7919 % 83)).strip() + (" hot" if i % 3 else ""), source(i)) for i in range(n)]


SCHEMA = "doc_id bigint, text string, source string"


def test_shards_are_even_and_slots_gapless(spark):
    rows = rows_of(3000) + [(10_000 + i, "the same text " * 9, "s0") for i in range(1500)] + [(-1, None, None), (None, "", "s")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", shard int")
    got = shards.digest(frame).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    share = sum(sizes.values()) / 40
    most = max(r.size for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(40))
    assert all(abs(s - share) <= 2 * most + 0.01 * share for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    again = {(r.doc_id, r.shard, r.slot) for r in shards.digest(frame.repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_slots_do_not_depend_on_the_intervals_they_are_sorted_in(spark, monkeypatch):
    frame = spark.createDataFrame(rows_of(900), SCHEMA)
    whole = {(r.doc_id, r.shard, r.slot) for r in shards.digest(frame).collect()}
    monkeypatch.setattr(shards, "ROWS_PER_SLOT_BIN", 3)
    assert {(r.doc_id, r.shard, r.slot) for r in shards.digest(frame).collect()} == whole


def test_equal_rows_and_rows_without_doc_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shards, "SPREAD", 100)
    rows = [(None, "the same text " * 20, "s0")] * 1000 + [(None, "the same text " * 20, f"t{i}") for i in range(500)] + [(7, "the same text " * 20, "s0")] * 500
    frame = spark.createDataFrame(rows, SCHEMA)
    got = shards.sharded(frame).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == 2000 and sorted(counts) == list(range(40)) and set(counts.values()) <= {49, 50, 51}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter((r[0], r[2]) for r in rows)
    place = lambda out: collections.Counter((r.doc_id, r.source, r.shard, r.slot) for r in out)
    assert place(shards.sharded(frame.repartition(3)).collect()) == place(got)


def test_splitters_equal_a_full_sort(spark):
    draw = np.random.default_rng(4)
    high = draw.integers(0, 1 << 60, 3000)
    high[:1200] = high[0]
    rows = [(int(h), int(draw.integers(0, 1 << 60)), int(draw.integers(16, 900))) for h in high] + [(5, 9, 40_000)]
    edges = shards.splitters(spark.createDataFrame(rows, "high bigint, low bigint, size bigint"), 40)
    assert edges == sorted(edges) and len(edges) == 39
    order = sorted(rows)
    share = sum(r[2] for r in rows) / 40
    for i, edge in enumerate(edges, 1):
        below = sum(r[2] for r in order if r[:2] < edge)
        reach, best = 0, None  # the nearest place where a full sort could cut
        for r in [*order, (0, 0, 0)]:
            best = reach if best is None or abs(reach - i * share) < abs(best - i * share) else best
            reach += r[2]
        assert abs(below - i * share) <= max(shards.TOLERANCE * share, abs(best - i * share) + 1e-6)


def test_shards_of_rows_with_nested_columns(spark):
    frame = spark.createDataFrame([(1, "a", {"k": 1}, [1])] * 3 + [(1, "a", {"k": 2}, None)], "doc_id bigint, text string, m map<string,int>, copy array<int>")
    got = shards.sharded(frame, 2).collect()
    assert len(got) == 4 and sum(r.m == {"k": 1} and r["copy"] == [1] for r in got) == 3


def test_shards_of_few_rows(spark):
    frame = spark.createDataFrame([(1, "a", "s"), (1, "a", "s")], SCHEMA)
    got = shards.sharded(frame)
    assert got.count() == 2 and got.columns == ["doc_id", "text", "source", "shard", "slot"]
    assert shards.sharded(frame.limit(0)).count() == 0


def shares(sizes):
    """Targets by resharing until none is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = total - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else free * weight[s] / rest for s in names}
        more = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not more:
            return target
        full |= more


def test_mix_meets_its_targets(spark):
    rows = rows_of(4000, lambda i: None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}") + [(9000, None, "s1"), (9001, "", "empty")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", size int")
    got = {r.doc_id: r for r in mixing.mixed(frame).collect()}
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    source = {r[0]: r[2] for r in rows}
    sizes, taken = collections.Counter(), collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
        taken[source[i]] += got[i].taken
        assert got[i].size == n and got[i].taken in (0, n, 2 * n)
    target = shares(sizes)
    for i in size:
        assert math.isclose(got[i].target, target[source[i]], rel_tol=1e-9, abs_tol=1e-9) and got[i].source_size == sizes[source[i]]
    assert all(abs(taken[s] - target[s]) <= 84 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mixed(frame.repartition(5)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    rows_out = collections.Counter(r.doc_id for r in mixing.mix_sources(frame).collect())
    assert all(rows_out[i] * n == got[i].taken for i, n in size.items() if n)
    assert mixing.mixed(frame.limit(0)).count() == 0


def test_rows_without_doc_id_and_equal_rows_are_rounded_one_by_one(spark):
    ten = "one two three four five six seven eight nine "
    rows = [(None, ten + str(i), "a") for i in range(300)] + [(None, ten + "x", "b")] * 200 + [(5, ten + "x", "b")] * 100 + [(i, ten + "y", "c") for i in range(10)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert collections.Counter(r.taken in (0, 10, 20) for r in mixing.mixed(frame).collect()) == {True: 610}
    split = mixing.mixed(frame.where("source <> 'b'")).collect()
    assert abs(sum(r.taken for r in split if r.source_size == 3000) - next(r.target for r in split if r.source_size == 3000)) <= 5
    equal = mixing.mixed(frame.where("source = 'b' OR source = 'c'")).collect()
    assert abs(sum(r.taken for r in equal if r.source_size == 3000) - next(r.target for r in equal if r.source_size == 3000)) <= 5
    out = mixing.mix_sources(frame)
    assert out.columns == ["doc_id", "text", "source"] and max(collections.Counter(out.where("doc_id < 5").select("doc_id").collect()).values()) <= 2


def test_mix_through_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    frame = spark.createDataFrame(rows_of(1200, lambda i: "ab"[i % 2]), SCHEMA)
    got = mixing.mixed(frame).collect()
    by = collections.defaultdict(float)
    for r in got:
        by[r.target, r.source_size] += r.taken
    assert len(got) == 1200 and all(abs(n - target) <= 84 for (target, _), n in by.items())


def test_pivotal_rounding_keeps_mass_and_means():
    draw = np.random.default_rng(1)
    size, p = draw.integers(1, 50, 40).astype(float), draw.uniform(0.05, 0.95, 40)
    runs = np.array([mixing.settle_block(size, p, draw.uniform(size=40)) for _ in range(4000)])
    assert np.allclose(runs @ size, p @ size) and ((runs > 0) & (runs < 1)).sum(1).max() <= 1
    assert np.abs(runs.mean(0) - p).max() < 0.05


DOCS = [(i, f"the Cat sat on mat {i % 4} and word{i} ran; end.") for i in range(60)] + [(100, None), (101, " \n"), (102, "Zq!é zzxx neverseen " * 3), (None, "the cat")]


def test_suffix_tree_base_and_distribution(spark):
    frame = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id bigint, text string, score int")
    got = {r.doc_id: r for r in suffix_tree.scored(frame).collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in DOCS}
    counts = collections.Counter(w for i, t in DOCS if not held[i] for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    for i, t in DOCS:
        w, r = tokens(t), got[i]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert got[0].score > got[102].score
    assert suffix_tree.scored(frame.limit(0)).count() == 0


def test_rare_words_by_join_equal_lookup(spark, monkeypatch):
    frame = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    looked_up = {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in suffix_tree.scored(frame).collect()}
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.05)
    assert {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in suffix_tree.scored(frame).collect()} == looked_up


def arrays(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_symbols_and_contexts():
    classes, raw, starts = suffix_tree.symbols(*arrays("Ab  c", "", " \n", "d", "é"))
    assert bytes(raw) == b"ab c\0\0\0d\0\xc3\xa9\0" and starts.tolist() == [0, 5, 6, 7, 9, 12]
    assert [i for i, c in enumerate(classes) if c == 0] == [4, 5, 6, 8, 11]
    codes = suffix_tree.contexts(classes, starts)
    assert codes[0] == codes[5] == codes[7] == 0 and codes[1] == int(classes[0]) << 18
    text = np.searchsorted(starts, np.arange(12), side="right") - 1
    for depth in range(1, 9):
        plain = [sum(int(classes[i - k]) << 6 * (depth - k) for k in range(1, depth + 1) if i - k >= starts[text[i]]) for i in range(12)]
        assert suffix_tree.contexts(classes, starts, depth).tolist() == plain


@pytest.mark.parametrize("n", [0, 1, 2, 700, 5000])
def test_places_of_keys_in_order(n):
    draw = np.random.default_rng(n)
    for most in (3, 1 << 14, 1 << suffix_tree._KEY):
        keys = draw.integers(0, most, n) | (most >> 1)
        assert suffix_tree.order_of(keys).tolist() == np.argsort(keys, kind="stable").tolist()
        found, back = suffix_tree.told_apart(keys)
        want = np.unique(keys, return_inverse=True)
        assert found.tolist() == want[0].tolist() and back.tolist() == want[1].tolist()
    many = draw.integers(0, 1 << suffix_tree._KEY, 300_000 if n == 5000 else n)  # a key's bits and a place's don't fit in 63
    assert (suffix_tree.order_of(many) == np.argsort(many, kind="stable")).all()


@pytest.mark.parametrize("places", [1, 5000, 1 << 17])
def test_keys_are_gathered_by_one_sort(places):
    draw = np.random.default_rng(places)
    keys = draw.integers(0, 1 << suffix_tree._KEY, places // 3 + 1)[draw.integers(0, places // 3 + 1, places)]
    order = suffix_tree.near_order(keys)
    assert np.sort(order).tolist() == list(range(places))
    high = keys[order] >> suffix_tree._BITS * (suffix_tree.DEPTH - suffix_tree.TOP)
    assert (np.diff(high) >= 0).all()
    found, back = suffix_tree.told_apart(keys, suffix_tree.near_order)
    assert (found[back] == keys).all() and len(found) < 1.01 * len(np.unique(keys))


def test_counts_go_through_their_byte_planes():
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 1 << suffix_tree._KEY, 5000))
    n = draw.integers(1, 1 << 31, len(keys))
    rows = [r for b in suffix_tree._packed(keys, n) for r in b.to_pylist()]
    back = [suffix_tree._unpacked(r["blob"]) for r in rows]
    assert np.concatenate([k for k, _ in back]).tolist() == keys.tolist() and np.concatenate([c for _, c in back]).tolist() == n.tolist()
    assert all((k >> suffix_tree._BELOW == r["bucket"]).all() for r, (k, _) in zip(rows, back, strict=True))


def test_shorter_contexts_take_over_the_counts():
    draw = np.random.default_rng(5)
    pairs, count = np.unique(draw.integers(0, 4, (3000, 4)) @ (1 << 6 * np.arange(4)), return_counts=True)
    want = collections.Counter()
    for x, c in zip(pairs.tolist(), count.tolist(), strict=True):
        want[x >> 12 << 6 | x & 63] += c
    found, n, back = suffix_tree._shorter(pairs, count)
    assert found.tolist() == sorted(want) and n.tolist() == [want[x] for x in sorted(want)]
    assert found[back].tolist() == [x >> 12 << 6 | x & 63 for x in pairs.tolist()]


@pytest.mark.parametrize("piece", [1, 7, 1 << 15])
def test_pieces_of_keys_get_the_same_chances(monkeypatch, piece):
    texts = arrays(*["the cat sat on the mat and ran; the end " * 3, "a cat on a mat", "zebra tone falls", "tone"] * 40)
    classes, _, starts = suffix_tree.symbols(*texts)
    keys = np.sort((suffix_tree.contexts(classes, starts, suffix_tree.DEPTH) << 6) | classes)
    packed = list(suffix_tree._packed(*np.unique(keys, return_counts=True)))
    rows = [r for b in suffix_tree._subtrees(iter(packed)) for r in b.to_pylist() if r["depth"] > suffix_tree.TOP]
    Row = collections.namedtuple("Row", rows[0])
    block = suffix_tree.Block(sorted((Row(**r) for r in rows), key=lambda r: (r.bucket, r.depth)))
    p = np.full(len(keys), 0.25)
    monkeypatch.setattr(suffix_tree, "PIECE", piece)
    block.refine(keys, p)
    states = {}
    for r in rows:
        pair, n = np.frombuffer(suffix_tree._unpressed(r["blob"]), np.int64).reshape(2, -1)
        for x, k in zip(pair.tolist(), n.tolist(), strict=True):
            states.setdefault((r["depth"], x >> 6), {})[x & 63] = k
    assert len({d for d, _ in states}) > 3
    for key, got in zip(keys.tolist(), p.tolist(), strict=True):
        want = 0.25
        for depth in range(suffix_tree.TOP + 1, suffix_tree.DEPTH + 1):
            own = states.get((depth, key >> 6 * (suffix_tree.DEPTH - depth + 1)))
            if own is None:
                break
            want = (own.get(key & 63, 0) + suffix_tree.MASS * want) / (sum(own.values()) + suffix_tree.MASS)
        assert math.isclose(got, want, rel_tol=1e-12)


def test_tree_is_a_distribution(spark):
    docs = spark.createDataFrame([(t,) for _, t in DOCS], "text string").coalesce(1)
    tree = suffix_tree.grow(docs.mapInArrow(suffix_tree._count, "kind int, k bigint, n bigint"), suffix_tree.subtrees(docs))
    assert len(tree.codes) > 5 and np.allclose((10**tree.log).sum(1), 1)
    own = suffix_tree._CLASS.copy()
    own[65:91] = 0
    for c in set(own.tolist()) - {0}:
        assert math.isclose((10 ** tree.emit[own == c]).sum(), 1, rel_tol=1e-9)


PAGES = [(1, "http://a/ b", "x" * 200), (2, None, "x" * 200), (3, "u", "é" * 60), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (0, "u", "é" * 60), (None, "u", "x" * 200), (7, "u", "b\r\n\r\n" * 60_000)]


def test_warc_round_trip(spark):
    frame = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id bigint, url string, html string, digest string")
    got = {r.page_id: r for r in warc.digest(frame).collect()}
    assert len(got) == len(PAGES)
    refers = {2: 1, 3: 0, None: 1}
    for i, _, html in PAGES:
        data = (html or "").encode()
        want = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if i in refers else "response", refers.get(i))
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert warc.digest(frame.limit(0)).count() == 0


def test_archives_are_whole_gzip_members_with_payloads(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    archives = warc.write_archives(frame, str(tmp_path))
    texts = {r.page_id: r.payload for r in warc.read_archives(archives, str(tmp_path)).collect()}
    assert texts[7].decode() == PAGES[-1][2] and texts[2] is None
    files = list(tmp_path.glob("*.warc.gz"))
    assert files and sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == len(PAGES)


def test_damaged_archives_are_refused():
    good = warc.record(1, "u", b"payload " * 40, None, False)
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(good * 3))] == [320] * 3
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"payload payload", b"payload Payload"), plain[:-4], plain.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1), plain + b"x"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-20])))


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len(x) for x in P.STAGES] == [2] * 5
    ids = lambda frame: collections.Counter(r.doc_id for r in frame.select("doc_id").collect())
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and not set(ids(out)) - set(ids(docs))
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = P.STAGES[-1][1](spark, docs, sf)
    assert ids(last) == ids(docs) and last.columns == [*docs.columns, "shard", "slot"]
    assert ids(P.run(spark, sf)) == ids(last)


def brute_force_tree(texts, depth, least, divergence, mass):
    """log10 P(classes) of a text by a suffix tree over plain tuples, and its contexts."""
    seen = collections.defaultdict(collections.Counter)
    sequences = {}
    for t in texts:
        classes = suffix_tree.symbols(*arrays(t))[0].tolist()
        sequences[t] = [0] * depth + classes
        for i in range(depth, depth + len(classes)):
            for d in range(depth + 1):
                seen[tuple(sequences[t][i - d : i])][sequences[t][i]] += texts[t]
    kept = {()}
    for c, own in seen.items():
        n, above = own.total(), seen[c[1:]]
        if c and n >= least and sum(k * math.log(k / n / (above[x] / above.total())) for x, k in own.items()) >= divergence:
            kept |= {c[k:] for k in range(len(c))}

    def chance(c, x):
        own = seen[c]
        return (own[x] + 1) / (own.total() + 64) if not c else (own[x] + mass * chance(c[1:], x)) / (own.total() + mass)

    def score(t):
        row = [0] * depth + suffix_tree.symbols(*arrays(t))[0].tolist()
        contexts = (next(tuple(row[i - d : i]) for d in range(depth, -1, -1) if tuple(row[i - d : i]) in kept) for i in range(depth, len(row)))
        return sum(math.log10(chance(c, x)) for c, x in zip(contexts, row[depth:], strict=True))

    return score, kept


@pytest.mark.parametrize("block", [1, 64_000_000])
def test_score_equals_a_brute_force_tree(spark, monkeypatch, block):
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("etaoinshr"), 5)) for _ in range(40)]
    rows = [(i, " ".join(draw.choice(words, 30))) for i in range(100)] + [(200 + i, "zebra tone falls") for i in range(9)] + [(300 + i, "the tone rings") for i in range(70)] + [(400, ""), (401, None)]
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", block)
    train = collections.Counter(t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 10)
    score, kept = brute_force_tree(train, suffix_tree.DEPTH, suffix_tree.LEAST_COUNT, suffix_tree.DIVERGENCE, suffix_tree.MASS)
    assert tuple(suffix_tree._CLASS[list(b"a tone ")]) in kept
    got = {r.doc_id: r.score for r in suffix_tree.scored(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert all(math.isclose(got[i], score(t or ""), rel_tol=1e-9) for i, t in rows)


def test_states_are_chosen_by_count_and_not_by_share(spark):
    rows = [("the tone rings and again " * 400,)] * 60 + [("zebra tone falls",)] * 12  # 12 of 600,000 positions
    states = suffix_tree.subtrees(spark.createDataFrame(rows, "text string"))
    wanted = sum(int(c) << (6 * k) for k, c in enumerate(suffix_tree._CLASS[list(b"a tone ")]))
    codes = {depth: set(code.tolist()) for b in suffix_tree.blocks_of_states(states) for depth, code, *_ in b.levels}
    assert wanted in codes[7]
