"""The training-data operators: brute force, round trips, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import classes, p1_scans, p2_split, p3_private, p3_tagger, p4_lookalikes, p5_pairs, p6_similar, p7_leaks, p8_mixture, p9_reading
from ferrule.llm.p3_train import HELD_OUT, Maker, check_character
from ferrule.llm.queries import QUERIES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


PAGES = [
    "Blue Manual\nThe records room must approve the vendor direc-\ntory and the loan slip. See AB-\n1234 for details.\n- 1 -",
    "Blue Manua1\nThe records room must approve the vendor directory\nand the 1oan slip in pre-\nand post-sale service.\n- 2 -",
    "Blue Manual\nThe records room must approve the vendor directory\nand the loan slip on 10/10/2O24.\nQuantity\n5\n7\nTotal\n12",
    "The records room must approve the vendor directory and\nthe loan slip. The records room must approve the ven¬\nBlue Manual\n4",
    "dor directory and the loan slip.\nBlue Manual\nv",
]


def test_p1_damage_and_repair(spark):
    data = [(i, "d", i, t, "page") for i, t in enumerate(PAGES)] + [(20 + i, "e", i, "The records room must approve the vendor directory and the loan slip.", "page") for i in range(20)]
    data += [(90, "d", 9, None, "page"), (91, "d", 9, "", "page"), (92, None, None, "7", "page"), (93, "d", 1, "x", "text")]
    df = spark.createDataFrame(data, "segment_id long, document_id string, seq int, text string, content_type string").withColumn("damage", F.lit("clash"))
    got = {r.segment_id: (set(r.damage), r.body) for r in p1_scans.page_damage(df).collect()}
    assert got[0][0] == {"hyphen", "header", "page_number"}
    assert "vendor directory and the loan slip. See AB-1234" in got[0][1] and "Blue" not in got[0][1]
    assert got[1][0] == {"glyph", "header", "page_number"} and "the loan slip in pre- and post-sale" in got[1][1]
    assert got[2][0] == {"glyph", "header"} and "10/10/2024" in got[2][1]
    assert got[3][0] == {"hyphen", "header", "page_number"} and got[3][1].endswith("approve the vendor")
    assert got[4][0] == {"header", "page_number"} and got[4][1].startswith("directory")
    assert got[90] == (set(), "") and got[91] == (set(), "") and 93 not in got
    assert p1_scans.page_damage(df.limit(0)).count() == 0


# 2


@pytest.mark.parametrize("text", ["", "short", "x" * 3000, "a b " * 900, "# H\n\n" + "One two three. " * 200 + "\n\n## K\n- item\n" * 90, "句子，句子。" * 400, "<h1>A</h1><p>" + "word " * 800 + "</p>", "y" * 513, "\n" * 1500])
@pytest.mark.parametrize("limit", [512, 2000])
def test_p2_round_trip(text, limit):
    spans = p2_split.split_text(text, limit)
    assert all(b - a <= limit for a, b in spans)
    assert "".join(text[a if k == 0 else a + 64 : b] for k, (a, b) in enumerate(spans)) == text
    assert all(y[0] == x[1] - 64 for x, y in zip(spans, spans[1:]))


def test_p2_cuts_at_pauses():
    text = " ".join(f"Sentence number {i} ends here." for i in range(100))
    assert all(text[:b].rstrip().endswith(".") for _, b in p2_split.split_text(text, 512))
    assert p2_split.is_unbroken("z" * 513, 512) and not p2_split.is_unbroken("z" * 512 + "." + "z" * 512, 512)


# 3


def test_p3_gradient_is_right():
    tagger = p3_tagger.Tagger("abc")
    r = np.random.default_rng(0)
    ids, gold = r.integers(0, 7, (6, 3)), r.integers(0, p3_tagger.TAGS, (6, 3))
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, g = tagger.loss_and_gradient(ids, gold)
    for k in ("hf", "xb", "ef", "trans", "bias"):
        at = tuple(0 if n == 1 else 1 for n in tagger.p[k].shape)
        at = (int(ids[0, 0]),) + at[1:] if k[0] == "x" else at
        old, step = tagger.p[k][at], 1e-5
        tagger.p[k][at] = old + step
        up, _ = tagger.loss_and_gradient(ids, gold)
        tagger.p[k][at] = old - step
        down, _ = tagger.loss_and_gradient(ids, gold)
        tagger.p[k][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[k][at], rel=2e-2, abs=1e-4)


def test_p3_held_out_accuracy():
    """Sentences whose frames the training never saw: exact starts, kind by kind."""
    make = Maker(12345, frames=HELD_OUT)
    hit, made, found = Counter(), Counter(), Counter()
    texts, gold = [], []
    for _ in range(500):
        parts, spans, at = [], set(), 0
        for _ in range(4):
            s, marks, _ = make.sentence()
            spans |= {(at + a, k) for a, _, k in marks}
            parts.append(s + "\n\n")
            at += len(s) + 2
        texts.append("".join(parts))
        gold.append(spans)
    for g, spans in zip(gold, p3_private.mentions(texts)):
        got = {(a, k) for a, _, k in spans}
        hit.update(k for _, k in got & g)
        made.update(k for _, k in g)
        found.update(k for _, k in got)
    figures = {k: (hit[k] / made[k], hit[k] / found[k]) for k in made}
    # Names in sentences of unknown form are the tagger's weak side: measured 0.66 and 0.85, see the README.
    name = figures.pop("name")
    assert len(figures) == 4 and all(recall >= 0.9 and precision >= 0.9 for recall, precision in figures.values()), figures
    assert name[0] >= 0.6 and name[1] >= 0.8, name


def test_p3_pruned_decoding_is_exact():
    tagger = p3_private._tagger()
    make = Maker(7)
    texts = ["\n\n".join(make.sentence()[0] for _ in range(5)) for _ in range(40)]
    pruned = tagger.tag(texts)
    for t, spans in zip(texts, pruned):
        e = tagger.emissions([tagger.encode(t)])[0]
        path = tagger.viterbi([e])[0]
        begins = {i for i, x in enumerate(path) if x and (x % 2 == 1 or i == 0 or path[i - 1] == 0)}
        assert {a for a, *_ in spans} == begins


def test_p3_edges():
    assert p3_private.mentions([None, "", " "]) == [[], [], []]
    long = "Nothing to see here. " * 4000 + "Please write to anna.lee@mail.example today."
    spans = p3_private.mentions([long])[0]
    assert [(long[a:b], k) for a, b, k in spans] == [("anna.lee@mail.example", "email")]
    assert p3_private.masked(long, spans).endswith("write to [EMAIL] today.")
    assert p3_private.masked(None, []) is None
    good = "11010119900307123"
    assert p3_private.valid_id(good + check_character(good)) and not p3_private.valid_id("110101199013071234") and p3_private.valid_id("123-45-6789")


# 4


def test_p4_forms():
    c = p4_lookalikes.canonical
    assert c(None) is None and c("") == ""
    assert c("Ｂａｓｏ－７９") == c("Baѕo-79".replace("ѕ", "s")) == c("Bа​so‑79") == "Baso-79"
    assert c("noël") == c("noël") and c("noel") != c("noël") and c("A") != c("a") and c("a_b") != c("a-b")
    assert c("a b") == c("a　b") == "a b" and c("a\nb") != c("a b")
    p = p4_lookalikes.canonical_phone
    assert p("+86 138-1234 5678") == p("l38l2345678") == p("00861381234５678") == "13812345678"
    assert p("12345") is p(None) is p("") is None


def test_p4_splicing_equals_whole_normalisation():
    r = random.Random(4)
    pool = "abcé中，ｏ́̈​ Ａо３- \n\u1100\u1161\u11a8\uac00\uac01\u0451\u03ac\u043a\u0653\u0627"
    for _ in range(2000):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 12)))
        whole = p4_lookalikes._segment(s)
        assert p4_lookalikes.canonical(s) == whole
        assert p4_lookalikes.canonical(whole) == whole


def test_p4_pairs(spark):
    data = [(1, "abc"), (2, "ａbc"), (3, "abc"), (4, None), (5, " "), (6, "none"), (7, "ｎone"), (8, "xyz")]
    df = spark.createDataFrame(data, "id long, value string").withColumn("form", F.lit("clash"))
    forms = p4_lookalikes.lookalike_forms(df, "id", "value", "f")
    assert [r[1:] for r in rows(p4_lookalikes.equal_readings(forms))] == [(1, 2), (2, 3)]
    assert p4_lookalikes.equal_readings(forms.limit(0)).count() == 0


def test_p4_hot_reading_keeps_every_row(spark):
    hot = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'abc' when id % 3 = 1 then 'ａbc' else 'abｃ' end as value")
    pairs = p4_lookalikes.equal_readings(p4_lookalikes.lookalike_forms(hot, "id", "value", "f"))
    got = pairs.collect()
    assert {x for r in got for x in (r.id_a, r.id_b)} == set(range(3000)) and len(got) < 6100
    assert all(r.id_a % 3 != r.id_b % 3 for r in got)
    every = p4_lookalikes.readings(p4_lookalikes.lookalike_forms(hot, "id", "value", "f")).collect()
    assert len(every) == 3000 and all((r.class_id, r.rep, r.copies, r.links) == (0, r.id % 3, 1000, 2000) for r in every)


def test_p4_reading_stored_in_many_ways(spark):
    rows_ = [(i, "a" + chr(0x200B + i % 3) * (i // 3 + 1) + "b") for i in range(60)]
    forms = p4_lookalikes.lookalike_forms(spark.createDataFrame(rows_, "id long, value string"), "id", "value", "f")
    assert p4_lookalikes.equal_readings(forms).count() == 60 * 59 // 2
    star = p4_lookalikes.equal_readings(forms, most=10).collect()
    assert sorted((r.id_a, r.id_b) for r in star) == [(0, i) for i in range(1, 60)]
    assert {r.class_id for r in p4_lookalikes.readings(forms).collect()} == {0}


# 5


def test_p5_held_out_defects():
    make = random.Random(9)
    pairs = []
    for i in range(400):
        n = make.randint(1, 999)
        pairs += [(f"How long is the warranty for Unit{i}?", f"{n} months.", True), (f"{i}号仓库的保修期多长？", f"{n}个月。", True), (f"Who approves form {i}?", f"The finance desk approves it within {n} days.", True), (f"报销单{i}由谁审批？", f"由财务中心在{n}天内审批，逾期作废。", True)]
    model = p5_pairs.fit_pairs(pairs)
    ask, zh = "Who approves form 77777?", "报销单88888由谁审批？"
    cases = [((ask, None, True), "empty"), ((ask, "TBD", True), "empty"), ((zh, "​", True), "empty"), ((ask, "The finance desk approves it within", True), "truncated"), ((zh, "由财务中心在30天内审批，其中", True), "truncated"),
             ((ask, "I'm sorry, but I cannot answer this.", True), "refusal"), ((zh, "对不起，我无法回答这个问题。", True), "refusal"), ((ask, ask, True), "copy"), ((zh, zh, False), "copy"), ((ask, "由财务中心在30天内审批，逾期作废。", True), "language"), ((zh, "The finance desk approves it within 8 days.", True), "language"),
             ((ask, "The finance desk approves it within 8 days", True), None), ((zh, "由财务中心在8天内审批，逾期作废。", True), None), ((zh, None, False), None)]
    got = model.decide([c for c, _ in cases])
    assert sum(g == w for g, (_, w) in zip(got, cases)) >= len(cases) - 1, list(zip(got, cases))


def test_p5_edges(spark):
    df = spark.createDataFrame([("a", None, None, None), ("b", "", "", True)], "id string, question string, reference_answer string, answerable boolean").withColumn("defect", F.lit(1))
    assert p5_pairs.broken_pairs(df).columns == ["id", "defect"] and p5_pairs.broken_pairs(df).count() <= 2
    assert p5_pairs.broken_pairs(df.limit(0)).count() == 0


# 6


def expanded(pairs, members):
    one = F.lit("f").alias("field")
    return classes.expanded(pairs.select(one, "id_a", "id_b"), members.select(one, "id", "rep", "copies"), inside=True)


def _near(r, base, edits):
    s = list(base)
    for _ in range(edits):
        k = r.randrange(len(s))
        s[k : k + r.choice([0, 1])] = r.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(s)


def test_p6_against_brute_force(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = ["", "ab", None, "abc", "abc", "a-b c", "ABC"]
    for n in (4, 8, 15, 30, 60, 120, 300):
        for _ in range(14):
            base = " ".join(r.choice(words) for _ in range(n))
            texts += [base, _near(r, base, 1), _near(r, base, max(1, n // 6)), _near(r, base, max(1, n // 3)), base.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("norm", F.lit("clash"))
    pairs, members = p6_similar.near_duplicates(df, "id", "t", "f")
    got = {(x.id_a, x.id_b) for x in expanded(pairs, members).collect()}
    norm = [re.sub(r"[\W_]+", "", (t or "").lower()) for t in texts]
    sets = [{s[i : i + 3] for i in range(len(s) - 2)} for s in norm]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    assert got == want
    assert {(x.id_a, x.id_b) for x in expanded(*p6_similar.near_duplicates(df, "id", "t", "f", exact=True)).collect()} == want


def test_p6_hot_copies_and_empty(spark):
    hot = spark.range(2000).selectExpr("id", "case when id < 1500 then 'the same text again' when id < 1990 then 'the same text again!' else concat('other words ', id * 7919 * id) end as t")
    pairs, members = p6_similar.near_duplicates(hot, "id", "t", "f")
    got = expanded(pairs, members).collect()
    assert {x for r in got for x in (r.id_a, r.id_b)} >= set(range(1990)) and len(got) < 5000
    pairs, members = p6_similar.near_duplicates(hot.limit(0), "id", "t", "f")
    assert expanded(pairs, members).count() == 0


def test_p6_short_texts_meet_in_proportion():
    """Unrelated short texts, four times as many, share no more than a few signatures."""
    r = random.Random(1)
    met = []
    for n in (5_000, 20_000):
        texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(10, 20))) for _ in range(n)]
        (a, _, _), dense = p6_similar.shared_signatures(*p6_similar.signatures(*p6_similar.trigram_sets(texts)))
        met.append(len(a))
        assert not dense
    assert met[1] <= 4 * met[0] + 50


def test_p6_hot_signatures_block_by_block():
    r = np.random.default_rng(2)
    sig, ids = r.integers(0, 30, 900).astype(np.uint64) << np.uint64(3) | r.integers(0, 8, 900).astype(np.uint64), r.integers(0, 200, 900)
    add = lambda got, found: got.update({(a, b): n for a, b, n in zip(*(x.tolist() for x in found))})
    want, got = Counter(), Counter()
    whole, none = p6_similar.shared_signatures(sig, ids, 10**9)
    few, dense = p6_similar.shared_signatures(sig, ids, 31)
    assert not none and dense
    add(want, whole)
    add(got, few)
    for kinds, members in dense:
        cut = [(kinds[i : i + 10], members[i : i + 10]) for i in range(0, len(members), 10)]
        for i, x in enumerate(cut):
            for y in cut[i:]:
                for part in p6_similar.block_pairs(*x, *y, same=x is y, rows=4):
                    add(got, part)
    assert set(got) == set(want)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 300)]
    df = spark.createDataFrame([("f", a, b) for a, b in pairs] + [("g", 40, 100)], "field string, id_a long, id_b long")
    got = {(r.field, r.id): r.group_id for r in classes.components(df).collect()}
    assert {got["f", i] for i in range(41)} == {0} and got["f", 102] == 100 and got["f", 300] == 200 and got["g", 100] == 40
    assert classes.components(df.limit(0)).count() == 0


# 7


def test_p7_against_brute_force(spark):
    r = random.Random(7)
    say = lambda n: "".join(r.choice("abcdefgh 中文字号，.") for _ in range(n))
    items = [(i, say(r.randint(30, 300))) for i in range(60)] + [(90, None), (91, ""), (92, "short")]
    docs = [(i, say(r.randint(0, 900))) for i in range(120)] + [(900, None), (901, "")]
    for k in range(120):
        i, t = docs[k]
        p = items[r.randrange(60)][1]
        a = r.randrange(max(1, len(p) - 45))
        cut = p[a : a + r.randint(30, 120)].upper().replace(".", " \n")
        docs[k] = (i, t[:200] + cut + t[200:])
    got = p7_leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    found = {(x.doc_id, x.item_id) for x in got.filter("run >= 40").collect()}
    plain = {i: p7_leaks.letters(t) for i, t in items}
    want = {(d, i) for d, t in docs for i, p in plain.items() if (n := p7_leaks.letters(t)) and any(p[k : k + 40] in n for k in range(len(p) - 39))}
    assert found == want and len(want) > 20


def test_p7_edited_passages():
    """Passages taken over with an edit in about every thirtieth letter, against brute force over the same windows."""
    r = random.Random(17)
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(i, say(r.randint(80, 420))) for i in range(60)]
    docs = []
    for i in range(120):
        p = list(items[i % 60][1])
        for _ in range(len(p) // 30):
            k = r.randrange(len(p))
            p[k : k + r.choice([0, 1, 1])] = r.choice("abcdefghijklmnopqrstuvwxyz")
        docs.append((i, say(r.randint(0, 300)) + "".join(p) + say(r.randint(0, 300))))
    indexes = [p7_leaks.ItemIndex(items, w) for w in (p7_leaks.WINDOW, *p7_leaks.SIZES)]
    found = {(d, i) for d, i, _, _ in p7_leaks._scan(indexes, [d for d, _ in docs], [t for _, t in docs])}
    want = set()
    for d, t in docs:
        item = items[d % 60][1]
        w = p7_leaks.own_size(len(item))
        index = next(x for x in indexes if x.window == w)
        if any(index.similarity(t[a : a + w], item[b : b + w]) >= p7_leaks.MIN_SIMILARITY for a in range(0, len(t) - w + 1, w // 4) for b in range(0, len(item) - w + 1, 2)):
            want.add((d, d % 60))
    assert len(want) > 60 and len(found & want) / len(want) >= 0.9 and all(d % 60 == i for d, i in found)


def test_p7_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(p7_leaks, "BLOCK_CHARS", 100)
    text = "abcdefghijklmnopqrstuvwxyz0123456789 the quick brown fox jumps"
    docs = spark.createDataFrame([(1, "x" + text), (1, "x" + text)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text + str(i)) for i in range(5)], "item_id long, passage string")
    assert {r.item_id for r in p7_leaks.leaked_items(docs, items).collect()} == set(range(5))
    assert p7_leaks.leaked_items(docs, items.limit(0)).count() == p7_leaks.leaked_items(docs.limit(0), items).count() == 0


# 8


def test_p8_exact_budgets(spark, monkeypatch):
    monkeypatch.setattr(p8_mixture, "RANGE_ROWS", 50)
    data = [(i, "big" if i % 10 else "small", 5 + i % 7) for i in range(1000)] + [(2000, None, 9), (2001, "untargeted", 9), (2002, "big", 0)]
    counted = spark.createDataFrame(data, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = p8_mixture.mix_sources(counted, targets)
    report = {r.source: r for r in p8_mixture.share_report(mix, targets).collect()}
    assert report["big"].actual_share == pytest.approx(5 / 9, abs=1e-3) and report["small"].actual_share == pytest.approx(4 / 9, abs=1e-3)
    assert report["small"].max_epoch <= 3 and report["big"].max_epoch == 1 and report["absent"].used_tokens == 0
    small = sum(t for _, s, t in data if s == "small")
    assert report["small"].used_tokens == 3 * small
    assert mix.groupBy("doc_id", "epoch").count().filter("count > 1").count() == 0
    cut = mix.filter("used_tokens < tokens").groupBy("source").count().collect()
    assert all(r["count"] <= 1 for r in cut)
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, p8_mixture.mix_sources(counted.repartition(7), targets).collect()))
    assert p8_mixture.mix_sources(counted.limit(0), targets).count() == p8_mixture.mix_sources(counted, targets.limit(0)).count() == 0
    over = p8_mixture.share_report(p8_mixture.mix_sources(counted, targets, total_tokens=10**9), targets).filter("source = 'big'").first()
    assert over.used_tokens == sum(t for _, s, t in data if s == "big")


def test_p8_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "k"), (2, None, "k"), (3, "", None)], "doc_id long, text string, extra string")
    got = {r.doc_id: (r.tokens, r.extra) for r in p8_mixture.token_counts(df).collect()}
    n = len(p8_mixture._encoding(p8_mixture.TOKENIZER).encode_ordinary("hello world"))
    assert n in (2, 3) and got == {1: (n, "k"), 2: (0, "k"), 3: (0, None)}


# 9


def test_p9_orders_levels(spark):
    easy = "We see the cat. It is red. You can sit. " * 6
    hard = "Notwithstanding the countervailing considerations articulated in the memorandum, the consortium's interpretive guidance obfuscates jurisdictional demarcation, whereas longitudinal heterogeneity undermines identification; "
    docs = [(i, easy + f"Number {i}." if i % 2 else hard * 3 + f"Appendix {i}.") for i in range(200)] + [(900, None), (901, ""), (902, "123 !!")]
    ratings = [(i, r, 3 if i % 2 else 13) for i in range(0, 120) for r in (1, 2)]
    d, r = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, rater int, grade int")
    got = {x.doc_id: x.grade for x in p9_reading.reading_grades(d, r).collect()}
    assert all((got[i] < 8) == bool(i % 2) for i in range(120, 200))
    assert got[900] is got[901] is got[902] is None
    assert all(x.grade is None for x in p9_reading.reading_grades(d, r.limit(0)).collect())
    assert p9_reading.reading_grades(d.limit(0), r).count() == 0


# All


def test_queries_run(spark):
    from conftest import SMALL

    for name, f in QUERIES.items():
        assert f(spark, SMALL).count() > 0 or name.startswith("p7_"), name  # so few documents hold no leak


def test_queries_run_on_empty_tables(spark, tmp_path):
    from pathlib import Path

    from conftest import SMALL

    for p in Path(SMALL).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(tmp_path / p.name))
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0 or name == "p8_shares", name
