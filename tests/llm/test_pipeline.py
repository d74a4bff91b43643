"""The pipeline against a plain version of its five stages, on a small corpus with rows of every kind."""

import collections
import random
import re

from test_corpus_operators import shares
from test_near_dup import brute, shingles
from test_text_operators import measures

import corpus_pipeline as P
from plumbline.llm import decontaminate, mixing, near_dup, quality, shards

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

def good(text):
    """Is no rule of the current policy broken?"""
    text = text or ""
    n, chars, symbols, repeated_lines, repeated = measures(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    broken = n < 10, 100 * repeated > 20 * n, 10 * symbols > 3 * n, 2 * repeated_lines > lines, chars > 12 * n, chars < 2 * n, letters and 10 * upper > 7 * letters
    return not any(broken)


def corpus():
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("abcdefghijkl", k=draw.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(draw.randint(8, 25)))) for i in range(6)] + [(None, " ".join(word() for _ in range(12))), (9, None), (9, "")]
    texts = []
    for k in range(90):
        text = [word() for _ in range(draw.randint(12, 120))]
        texts.append(" ".join(text))
        for _ in range(draw.choice([0, 0, 1, 3])):  # near copies and exact ones
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(len(text))] = word()
            texts.append(" ".join(text))
        if k % 9 == 0:
            texts.append(" ".join(text[:6] + [items[k // 9 % 7][1]] + [word() for _ in range(20)]))
    texts += ["too short", None, "", "x " * 300, "LOUD WORDS " + " ".join(w.upper() for w in texts[0].split()), "# $ % " * 40]
    rows = [(i, t, "en", ("hot" if i % 3 else f"s{i % 4}") if i % 17 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows, items


def write(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_equals_the_plain_stages(spark, tmp_path):
    rows, items = corpus()
    out = P.run(spark, write(spark, tmp_path, rows, items)).collect()
    kept = {r[0]: r for r in rows if good(r[1])}
    assert 20 < len(rows) - len([r for r in rows if good(r[1])]) or len(kept) < len(rows)
    groups = brute([(i, r[1]) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if groups[i][2]}
    sets = [shingles(t) for _, t in items if shingles(t)]
    clean = {i: r for i, r in kept.items() if not any(100 * len(s & shingles(r[1])) >= 75 * len(s) for s in sets)}
    assert len(clean) < len(kept) < len(rows)

    copies = collections.Counter(r.doc_id for r in out)
    size = {i: len(r[1].split()) for i, r in clean.items()}
    of, taken = collections.Counter(), collections.Counter()
    for i, r in clean.items():
        of[r[3]] += size[i]
        taken[r[3]] += size[i] * copies[i]
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    target = shares(of)
    assert all(abs(taken[s] - target[s]) <= max(size.values()) / 2 + 1e-6 for s in of)
    for r in out:
        assert tuple(r)[:5] == clean[r.doc_id]

    held, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        held[r.shard] += len((r.text or "").encode()) + 16
        slots[r.shard].append(r.slot)
    share, most = sum(held.values()) / 40, max(len((r.text or "").encode()) + 16 for r in out)
    assert all(abs(held[s] - share) <= 2 * most for s in range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    rows, items = corpus()
    odd = [(None, rows[0][1], None, None, None), (None, rows[0][1] + " and more words", "en", "hot", 1), (3, rows[40][1], "de", "s1", 0), (3, rows[41][1], None, "", 9)]
    odd += [rows[7], rows[7], (None, "one two three four five six seven eight nine ten eleven twelve " + "é" * 9, None, None, None)] * 2
    out = P.run(spark, write(spark, tmp_path, rows + odd, items))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] + ["shard", "slot"]
    found = out.collect()
    texts = collections.Counter(r.text for r in found)
    assert max(texts.values()) <= 2 and all(good(t) for t in texts)
    assert set(texts) <= {r[1] for r in rows + odd}


def test_empty_tables(spark, tmp_path):
    rows, items = corpus()
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert P.run(spark, write(spark, tmp_path / "a", [], items)).count() == 0
    assert P.run(spark, write(spark, tmp_path / "b", rows[:30], [])).count() > 0


def test_extra_columns_with_clashing_names(spark):
    rows, items = corpus()
    names = ["shard", "copies", "k1", "h0", "hit", "word0", "stays", "whole"]
    docs = spark.createDataFrame([(*r, *range(8)) for r in rows[:40]], SCHEMA + "".join(f", {n} int" for n in names))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for step in (quality.keep_good, near_dup.drop_near_duplicates, lambda d: decontaminate.decontaminated(d, benchmark), mixing.mix_sources):
        docs = step(docs)
        assert docs.columns == [*[c.split()[0] for c in SCHEMA.split(", ")], *names]
    out = shards.sharded(docs)
    assert len(set(out.columns)) == 15 and all(tuple(r)[5:13] == tuple(range(8)) for r in out.collect())


def test_ablations_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    judged = quality.judged(docs)
    rows = {r.rule: r for r in quality.ablations(judged.select("failed"), quality.POLICIES["base"]).collect()}
    plain = [measures(r.text) for r in docs.select("text").collect()]
    few, again = ([m[0] < 10 for m in plain], [100 * m[4] > 20 * m[0] for m in plain])
    assert (rows["few_words"].documents, rows["few_words"].fails, rows["few_words"].kept_without) == (len(plain), sum(few), sum(a and not b for a, b in zip(few, again)))
    assert (rows["repeated_words"].rejected, rows["repeated_words"].kept_without) == (sum(a or b for a, b in zip(few, again)), sum(b and not a for a, b in zip(few, again)))
    current = sum(good(r.text) for r in docs.select("text").collect())
    assert judged.where("kept").count() == current


def test_recall_of_near_duplicates_on_documents(spark):
    """Every link of the documents whose id is divisible by 20, against all rows, is within one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text) for r in docs}
    of = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs)).collect()}
    links = [(a, b) for a in sets if a % 20 == 0 and sets[a] for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = sum(of[a] == of[b] for a, b in links)
    assert links and found == len(links)
