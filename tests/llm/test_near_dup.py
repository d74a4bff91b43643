"""Near-duplicates and decontamination against brute force."""

import random

import pytest

from plumbline.llm import decontaminate, near_dup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus():
    """Chains of edits, exact copies, near copies around the limit, short texts."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    rows, n = [], 0
    for _ in range(12):
        text = [word() for _ in range(draw.randint(20, 90))]
        for _ in range(draw.randint(1, 9)):
            rows.append((n, " ".join(text)))
            n += 1
            if draw.random() < 0.7:
                for _ in range(draw.randint(1, 3)):
                    text[draw.randrange(len(text))] = word()
    for text in ("one", "One", "one two", "", None, " \n", "a b c d e", "A B C D E", "a b c d e f", "x " * 3000, "X " * 2900, "é ß ü a b", "É ß ü a b"):
        rows.append((n, text))
        n += 1
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, k1 int, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_large_group_of_near_copies(spark):
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(150):  # every copy differs from the base in one place, and from another copy in two
        text = list(base)
        text[draw.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_small_tables_are_kept_in_few_parts(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    parts, cut = [], near_dup.cut
    monkeypatch.setattr(near_dup, "cut", lambda frame: (kept := cut(frame), parts.append(kept.rdd.getNumPartitions()))[0])
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    assert len(parts) > 20 and sum(n >= 16 for n in parts) <= 6


def test_one_doc_id_with_several_texts(spark):
    t, u, v = "a b c d e f g h", "p q r s t u v w x y", "k l m n o p"
    rows = [(3, t), (5, t), (5, u), (7, u), (7, u), (7, v), (9, "A b c d e f g h"), (None, u), (None, "z z z"), (None, "Z z  z"), (None, "z y x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()), key=str)
    named = [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (7, 5, False), (7, 7, True), (9, 3, False)]
    assert got == sorted(named + [(None, None, True)] * 4, key=str)
    kept = sorted(((r.doc_id, (r.text or "").lower().split()[0]) for r in near_dup.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(3, "a"), (5, "p"), (7, "k"), (None, "z"), (None, "z")], key=str)


def test_many_texts_of_one_doc_id_and_of_none(spark):
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    rows = [(1, t) for t in texts] + [(None, t) for t in texts] + [(2, texts[0]), (2, texts[0] + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dup.near_duplicates(docs).filter("doc_id IS NOT NULL").collect()
    assert all(r.component_id == 1 for r in got) and sum(r.kept for r in got) == 40
    kept = near_dup.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((1, t) for t in texts)


@pytest.mark.parametrize("cell", [3, 512])
def test_pairs_of_cells_are_those_of_the_band(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dup, "CELL", cell)
    draw = random.Random(2)
    rows = []  # band b is the only one at place b
    for band in range(30):
        for node in draw.sample(range(60), draw.choice([2, 3, 20])):
            rows.append((band, node, node % 7, 100 + node, 100 + node, 20))
    sketches = {n: [draw.getrandbits(63) if n % 3 else 5 for _ in range(4)] for n in range(60)}
    sizes = {b: sum(r[0] == b for r in rows) for b in range(30)}
    held = {n: [1000 if any(r[:2] == (b, n) for r in rows) else n for b in range(30)] for n in range(60)}
    fields = "band bigint, place int, node bigint, component bigint, n bigint, s bigint, size bigint"
    members = spark.createDataFrame([(b, b, n, c, k, s, sizes[b]) for b, n, c, k, s, _ in rows], fields)
    frame = spark.createDataFrame([(n, s, held[n]) for n, s in sketches.items()], "node bigint, sketch array<bigint>, bands array<int>")
    found = [(r.a, r.b) for r in near_dup._pairs_left(members, frame, 90).collect()]
    got = sorted(found)
    assert len(found) == len(set(found))
    nodes = {b: [r[1] for r in rows if r[0] == b] for b in range(30)}
    bits = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(sketches[x], sketches[y]))
    close = lambda x, y: 175 * min(100 + x, 100 + y) >= 75 * (200 + x + y) and 100 * (100 + min(x, y)) >= 75 * (100 + max(x, y))
    want = {(x, y) for b in nodes for x in nodes[b] for y in nodes[b] if x < y and x % 7 != y % 7 and bits(x, y) <= 90 and close(x, y)}
    assert got == sorted(want) and want


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    rows = [(2, text), (2, text), (1, text), (None, text), (5, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(2, 1, False), (2, 1, False), (1, 1, True), (None, None, True), (5, 5, True), (None, None, True)], key=str)
    kept = sorted((r.doc_id for r in near_dup.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([1, 5, None], key=str)  # the text without doc_id is a copy of text 1; rows without words stay
    again = spark.createDataFrame([(7, text), (7, text)], "doc_id bigint, text string")
    assert near_dup.drop_near_duplicates(again).count() == 1
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 4, 5, 6, 20, 59, 300])]
    items += [(90, None), (91, " "), (92, items[4][1]), (None, items[4][1])]
    docs = []
    for i in range(60):
        body = [word() for _ in range(draw.randint(0, 400))]
        part = draw.choice(items)[1]
        if part and part.split():
            own = part.upper().split()
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = word()
            at = draw.randint(0, len(body))
            body[at:at] = own
        docs.append((i, " ".join(body), 7))
    docs += [(100, None, 1), (101, "", 1), (None, items[4][1], 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(frame, bench).collect()}
    want = set()
    for d, t, _ in docs:
        for i, b in items:
            own = shingles(b)
            both = len(own & shingles(t))
            if i is not None and both and 100 * both >= 75 * len(own):
                want.add((d, i, both, len(own)))
    assert got == want and len({d for d, *_ in want}) > 10
    clean = sorted(r.doc_id for r in decontaminate.decontaminated(frame, bench).collect())
    assert clean == sorted(d for d, *_ in docs if d is not None and d not in {w[0] for w in want})
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_many_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 30)
    items = [(i, " ".join(f"w{i}_{k}" for k in range(12))) for i in range(20)]
    docs = spark.createDataFrame([(i, "start " + t + " end") for i, t in items], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i, _ in items}


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_rows_are_judged_one_by_one_whatever_their_ids(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(12)) for x in "abcd")
    items = spark.createDataFrame([(1, a), (1, b), (None, c), (2, d), (2, d)], "item_id bigint, text string")
    docs = [(None, f"x {a} y"), (None, "clean one"), (None, None), (5, f"{b} end"), (5, "clean two"), (6, f"start {c}"), (7, d), (8, "clean three")]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(docs)], "doc_id bigint, text string, leaks int")
    kept = decontaminate.decontaminated(frame, items)
    assert kept.columns == frame.columns and sorted(r.leaks for r in kept.collect()) == [1, 2, 4, 7]
    found = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(frame, items).collect()), key=str)
    assert found == sorted([(None, 1, 8, 8), (5, 1, 8, 8), (7, 2, 8, 8)], key=str)


def test_small_tables_take_few_tasks(spark):
    draw = random.Random(8)
    base = [[f"w{draw.randrange(5000)}" for _ in range(60)] for _ in range(60)]
    rows = [(10 * i + k, " ".join(b if not k else [*b[:-k], *["x"] * k])) for i, b in enumerate(base) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("few", "tasks of a small table")
    try:
        kept = sorted(r.doc_id for r in near_dup.drop_near_duplicates(docs).collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept == [10 * i for i in range(60)]
    track = sc.statusTracker()
    jobs = [track.getJobInfo(j) for j in track.getJobIdsForGroup("few")]
    stages = {s: track.getStageInfo(s) for j in jobs for s in j.stageIds}
    assert sum(i.numCompletedTasks for i in stages.values() if i) < 1500
