"""Each operator against brute force or by its invariants, with nulls, ties, repeats, empty tables and clashing names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, epochs, languages, leakage, mixing, overlap, pairs, pivots, proportions, repetition, spans
from millrace.operators.words import Words

WORD = re.compile(r"[^\W_]+")


def runs(text, n=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similarity(a, b):
    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def some_texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))))
    return texts + [None, "", "   ", "_ -", "One TWO", "one two", "été 数学 x"]


def test_words_match_the_definition():
    texts = [t or "" for t in some_texts(40)] + ["A_b c²d 数学-题 ÀÉ", "İstanbul x"]
    w = Words(texts)
    assert w.counts().tolist() == [len(WORD.findall(t.lower())) for t in texts]
    of, h, _ = w.runs(5)
    seen = {}
    for i, t in enumerate(texts):
        ws = WORD.findall(t.lower())
        own = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)] if len(ws) >= 5 else [tuple(ws)] if ws else []
        hashes = h[of == i].tolist()
        assert len(own) == len(hashes)
        for key, x in zip(own, hashes):
            assert seen.setdefault(key, x) == x
    assert len(set(seen.values())) == len(seen)


def test_allocation_goes_to_siblings_then_cousins(spark):
    data = [("a", "x", 10, 4), ("a", "y", 5, 8), ("b", "x", 5, 100), ("b", "y", 0, 0)]
    leaves = spark.createDataFrame(data, "s string, t string, quota bigint, available bigint")
    got = {(r.s, r.t): (r.drawn, r.unmet) for r in proportions.allocate(leaves, ["s", "t"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", "x"): 4, ("a", "y"): 8, ("b", "x"): 8, ("b", "y"): 0}
    assert sum(v[1] for v in got.values()) == 0
    short = spark.createDataFrame([("a", "x", 10, 4), ("b", "x", 5, 6)], "s string, t string, quota bigint, available bigint")
    got = proportions.allocate(short, ["s", "t"]).collect()
    assert sum(r.drawn for r in got) == 10 and sum(r.unmet for r in got) == 5


def test_sample_to_targets(spark):
    data = [(f"i{i}", " S " if i % 2 else "s", "T" if i < 80 else None, "extra") for i in range(100)] * 2 + [(None, "s", "T", ""), ("z", None, "T", "")]
    records = spark.createDataFrame(data, "id string, source string, type string, rank string").select("id", "source", "type", "rank")
    targets = spark.createDataFrame([("S", "t", 0.5, 3), ("S", "u", 0.1, 4), (None, "u", None, None)], "source string, type string, target_share double, min_rows int")
    sample, report = proportions.sample_to_targets(records, targets, ["source", "type"], 20)
    got = {r.id for r in sample.collect()}
    assert len(got) == 14 == sample.count()
    again, _ = proportions.sample_to_targets(records.repartition(7), targets, ["source", "type"], 20)
    assert {r.id for r in again.collect()} == got
    assert {(r.source, r.type): (r.quota, r.available, r.short) for r in report.collect()}[("S", "u")] == (4, 0, 4)
    sample, report = proportions.sample_to_targets(records.limit(0), targets, ["source", "type"], 0)
    assert sample.count() == 0 and report.count() == 3


def test_cross_split_overlaps(spark):
    texts = some_texts(90)
    data = [(f"k{i:03d}", i % 3 == 0 if i % 11 else None, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data * 2, "key string, is_train boolean, text string, c1 int")
    linked, members = overlap.cross_split_overlaps(df, threshold=0.6, sketch_bits=14, cell=4)
    got = {(r.key_a, r.key_b) for r in overlap.record_pairs(linked, members).collect()}
    live = [d for d in data if d[1] is not None and d[2] is not None]
    want = {(a[0], b[0]) for a in live for b in live if a[0] < b[0] and a[1] != b[1] and similarity(a[2], b[2]) >= 0.6}
    assert got == want and want
    linked, members = overlap.cross_split_overlaps(df.limit(0))
    assert overlap.record_pairs(linked, members).count() == 0


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_near_duplicates_and_groups(spark, t):
    texts = some_texts(90, 5)
    data = [(f"k{i:03d}", x, "n") for i, x in enumerate(texts)]
    df = spark.createDataFrame(data * 2, "key string, text string, pivots string")
    near = pivots.near_duplicates(df, t, sketch_bits=14, cell=4)
    linked, members = near.pairs, near.members
    got = {(r.a, r.b) for r in pivots.record_pairs(linked, members).collect()}
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and similarity(a[1], b[1]) >= t}
    assert got == want and want
    root = {d[0]: d[0] for d in data if runs(d[1])}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {(r.key, r.group_id) for r in pivots.groups(linked, members).collect()} == {(k, find(k)) for k in root}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "y"), (None, "z")], "a string, b string")
    got = {r.id: r.root for r in components.connected_components(links).collect()}
    assert got == {f"{i:03d}": "000" for i in range(41)} | {"x": "x", "y": "x"}


def test_epoch_selection_keeps_members(spark):
    first = spark.createDataFrame([(f"p{i}", "e1") for i in range(200)] * 2 + [(None, "e1")], "id string, epoch string")
    later = spark.createDataFrame([(f"p{i}", "e0") for i in range(100, 400)], "id string, epoch string")
    empty = first.limit(0).withColumn("rate", F.lit(0.0))
    one = epochs.register(empty, first, 0.5)
    two = epochs.register(one, later, 0.1)
    before = {r.id for r in epochs.select(one).where("selected").collect()}
    after = {r.id for r in epochs.select(two.repartition(5)).where("selected").collect()}
    assert before <= after and 60 < len(before) < 140 and two.count() == 400
    assert not {r.id for r in epochs.select(epochs.register(empty, first, F.lit(None))).where("selected").collect()}


def test_late_older_rows_change_no_member(spark, tmp_path):
    from millrace.llm.queries import p4_selection

    def arrive(rows):
        spark.createDataFrame(rows, "parent_seed_id string, generated_at string").write.mode("append").parquet(f"{tmp_path}/gpt_pairs.parquet")
        rows = p4_selection(spark, str(tmp_path)).collect()
        assert len(rows) == len({r.parent_seed_id for r in rows})
        return {r.parent_seed_id: (r.epoch, r.rate) for r in rows}

    one = arrive([(f"p{i}", f"2026-0{1 + i % 3}-05") for i in range(200)] + [(None, "2026-01-01")])
    assert one and arrive([("p0", "2026-03-01")]) == one
    two = arrive([(f" p{i}", "2025-12-30") for i in range(300)])  # known ones late, and new ones
    assert one == {k: v for k, v in two.items() if int(k[1:]) < 200}
    assert {v for k, v in two.items() if int(k[1:]) >= 200} == {("2025-12", 0.2)}


def test_rates_of_known_parents_are_frozen(spark, tmp_path):
    from millrace.llm.queries import p4_selection

    def arrive(rows, partitions, **rates):
        spark.createDataFrame(rows, "parent_seed_id string, generated_at string").repartition(partitions).write.mode("append").parquet(f"{tmp_path}/gpt_pairs.parquet")
        return {r.parent_seed_id for r in p4_selection(spark, str(tmp_path), **rates).collect()}

    seen = [set()]
    for k, month in enumerate(["2026-02", "2026-03", "2025-11", "2026-01", None]):
        rows = [(f"p{i}", month and f"{month}-0{1 + i % 9}") for i in range(60 * k, 60 * k + 90)] + [(f"p{i}", "2025-01-01") for i in range(60 * k)]
        seen.append(arrive(rows, 1 + k, rates={"2026-01": 0.9 - k / 10, "2026-02": 0.5, "2026-03": 0.3}, other=k / 10))
        assert seen[-2] <= seen[-1]
    assert len(seen[-1]) > len(seen[1]) > 0
    other = tmp_path / "other"
    spark.createDataFrame([("q", "2026-01-01")], "parent_seed_id string, generated_at string").write.parquet(f"{other}/gpt_pairs.parquet")
    assert {r.parent_seed_id for r in p4_selection(spark, str(other), {}, 1.0).collect()} == {"q"}


def test_broken_nesting(spark):
    nan = float("nan")
    data = [("a", 0.25, True), ("a", 0.5, False), ("b", 0.5, True), ("b", 0.25, False), ("c", 0.5, True), ("c", 0.5, False), ("d", -1.0, True), ("d", 1.0, False), ("e", None, True), ("e", 1.0, False), ("f", 0.1, True), ("f", nan, False), (None, 0.1, True)]
    df = spark.createDataFrame(data * 2, "id string, rate double, selected boolean")
    assert [r.id for r in epochs.broken_nesting(df).collect()] == ["a"]


CASES = [
    ("What is 2 + 2 in total?", None, "4", "empty"),
    ("What is it?", "**Solution.**", "4", "empty"),
    ("What is it?", "We add the two and get 4.", "N/A", "empty"),
    ("What is it?", "We add the two and get 4.", "\xa0", "empty"),
    ("What is it?", "I'm sorry, but I can't help with this one. Hence 4.", "4", "refusal"),
    ("What is it?", "抱歉，我无法回答这个问题。", "4", "refusal"),
    ("A train leaves the town at speed 81 and meets another one after 33 minutes. How far is it?", "Solution: A train leaves the town at speed 81 and meets another one after 33 minutes. How far is it?", "4", "copy"),
    ("How many of the boxes in the town are empty when all of it is done?", "On compte les boîtes de la ville et il en reste exactement 4 pour tous les autres dans la ville.", "4", "language"),
    ("How many of the boxes in the town are empty when all of it is done?", "Сложив все уравнения, находим окончательный ответ, который равен 4.", "4", "language"),
    ("What is it?", "Adding the equations we get that the", "4", "truncated"),
    ("What is it?", "Adding the equations we get 14", "4", "truncated"),
    ("What is it?", "Adding the equations we get 4.", "\\frac{4}{", "truncated"),
    ("What is it?", "Only 4 works", "4", None),
    ("What is it?", "4.", "4", None),
    ("What is it?", "We cannot resist a picture. Thus the result is $\\frac{1}{2}$", "\\frac{1}{2}", None),
    (None, "It is 4.", "4", None),
]


@pytest.fixture(scope="module")
def language_model(spark):
    return languages.fit_languages(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("problem, solution, answer, kind", CASES)
def test_defects(language_model, problem, solution, answer, kind):
    other = languages.other_language(language_model, [problem or ""], [solution or ""])[0]
    assert pairs.defect(problem, solution, answer, other) == kind


@pytest.mark.parametrize("problem, solution, copied", [
    ("某城有三座桥，每座桥上每天经过的车辆数都相同，求总数。", "某城有三座桥，每座桥上每天经过的车辆数都相同。", True),
    ("某城有三座桥，每座桥上每天经过的车辆数都相同，求总数。", "某城有四座桥，每座桥上每日经过的车辆数都相同，求总量。", True),
    ("某城有三座桥，每座桥上每天经过的车辆数都相同，求总数。", "设每座桥有 n 辆车，三座桥共有 3n 辆，因此答案为 3n。", False),
    ("町には橋が三つあり、それぞれを毎日同じ数の車が通る。総数を求めよ。", "町には橋が三つあり、それぞれを毎日同じ数の車が通る。", True),
    ("町には橋が三つあり、それぞれを毎日同じ数の車が通る。総数を求めよ。", "一つの橋を n 台が通るとすると、合計は 3n 台である。", False),
    ("다리가 세 개 있고 매일 같은 수의 차가 지나간다. 모두 몇 대인가?", "다리가 세 개 있고 매일 같은 수의 차가 지나간다.", True),
])
def test_copies_in_scripts_without_spaces(problem, solution, copied):
    assert (pairs.defect(problem, solution, "3n") == "copy") == copied


REFUSALS = [
    "I am unable to give an answer here.", "I cannot produce a proof for that.", "Sorry, I could not find any solution.", "We can't supply a solution to this.", "Non posso fornire una risposta a questa domanda.", "Não posso resolver este problema.",
    "申し訳ありませんが、この問題にはお答えできません。", "No podemos ofrecer una solución.", "Je ne peux pas donner la solution.", "Ich kann hierzu keine Lösung angeben.", "Я не могу предоставить решение.", "죄송하지만 답변을 드릴 수 없습니다.",
    "Δεν μπορώ να σας βοηθήσω.", "لا يمكنني الإجابة على هذا.", "मैं इसका उत्तर नहीं दे सकता।", "אני לא יכול לענות על כך.", "ฉันไม่สามารถตอบได้",
]
NO_REFUSALS = [
    "We cannot find a solution with x > 0.", "So i cannot be 3, and the answer is 4.", "Hence i cannot be the answer.", "It follows that no solution can be given by even n.", "This cannot produce an answer above 4.",
    "Non possiamo avere x = 2, quindi la risposta è 4.", "Não podemos ter x = 2, então a resposta é 4.", "よって x は 2 にできない。答えは 4 である。", "Wir sehen, dass 3 nicht vorkommt, also ist die Lösung 4.", "따라서 x 는 2 일 수 없습니다. 답은 4.",
]


def test_refusals_align_with_slots():
    assert [t for t in REFUSALS if not pairs.is_refusal(t, "4")] == []
    assert [t for t in NO_REFUSALS if pairs.is_refusal(t, "4")] == []


def test_broken_pairs_table(spark):
    rows = [(f"k{i}", *c[:3], "x") for i, c in enumerate(CASES)] * 2 + [(None, "p", None, None, "x")]
    df = spark.createDataFrame(rows, "key string, problem string, solution string, answer string, defect string")
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert {(r.key, r.defect) for r in pairs.broken_pairs(df, documents).collect()} == {(f"k{i}", c[3]) for i, c in enumerate(CASES) if c[3]}
    assert pairs.broken_pairs(df.limit(0), documents).count() == 0
    unlabelled = {(r.key, r.defect) for r in pairs.broken_pairs(df, documents.limit(0)).collect()}
    assert {d for _, d in unlabelled} == {"empty", "refusal", "copy", "truncated", "language"}  # Russian still shows by its script


#: Texts of own making, none from the tables, in languages the model has seen and in others.
PROSE = {
    "en": ["The gardener counted every tulip in the long bed and wrote the sum on a wooden board.", "We multiply both sides by three and then compare what remains, which settles the claim."],
    "es": ["El jardinero contó todos los tulipanes del largo arriate y anotó la suma en una tabla de madera.", "Multiplicamos ambos lados por tres y comparamos lo que queda, con lo cual termina la prueba."],
    "fr": ["Le jardinier a compté toutes les tulipes de la longue plate-bande et noté la somme sur une planche.", "On multiplie les deux côtés par trois puis on compare ce qui reste, ce qui achève la preuve."],
    "de": ["Der Gärtner zählte jede Tulpe im langen Beet und schrieb die Summe auf ein hölzernes Brett.", "Wir multiplizieren beide Seiten mit drei und vergleichen dann den Rest, womit alles bewiesen ist."],
    "it": ["Il giardiniere ha contato tutti i tulipani della lunga aiuola e ha scritto la somma su una tavola di legno.", "Moltiplichiamo entrambi i lati per tre e poi confrontiamo ciò che resta, e questo conclude la prova."],
    "pt": ["O jardineiro contou todas as tulipas do longo canteiro e anotou a soma numa tábua de madeira.", "Multiplicamos ambos os lados por três e comparamos o que sobra, o que conclui a demonstração."],
    "ru": ["Садовник сосчитал все тюльпаны на длинной клумбе и записал сумму на деревянной доске."],
    "ja": ["庭師は長い花壇のチューリップをすべて数え、その合計を木の板に書いた。"],
    "ko": ["정원사는 긴 화단의 튤립을 모두 세어 그 합을 나무 판에 적었다."],
    "zh": ["园丁数清了长花坛里的每一朵郁金香，并把总数写在一块木板上。"],
    "el": ["Ο κηπουρός μέτρησε όλες τις τουλίπες και έγραψε το άθροισμα σε μια ξύλινη πινακίδα."],
}


def test_languages_of_texts_not_in_the_tables(language_model):
    """Italian and Portuguese are in no labelled row: they show against other languages, but not against Spanish, and not always one another."""
    unseen = {"it", "pt"}
    known, others, wrong = [], [], []
    for a, ps in PROSE.items():
        for b, ss in PROSE.items():
            for p in ps:
                for s in ss:
                    hit = bool(languages.other_language(language_model, [p], [s])[0])
                    if a == b:
                        wrong += [(a, p)] if hit and a not in unseen else []
                    elif not {a, b} & unseen:
                        known.append(hit)
                    elif not {a, b} <= {"es", *unseen}:
                        others.append(hit)
    assert not wrong and all(known) and sum(others) / len(others) >= 0.9, (len(known), sum(others), len(others))


def test_a_quoted_foreign_sentence_is_no_other_language(language_model):
    s = " ".join(PROSE["en"]) + " As the old book says: " + PROSE["fr"][0]
    assert not languages.other_language(language_model, [PROSE["en"][0]], [s])[0]
    assert not languages.other_language(language_model, ["$x$", "", PROSE["en"][0]], ["Also.", PROSE["fr"][0], "$\\frac{le}{la}$ 4"]).any()


def test_copies_by_subsequence_alone():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    found = wrong = 0
    for _ in range(60):
        p = [rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))]
        s = [f"new{rng.randrange(10**9)}" if i % 5 == 4 else w for i, w in enumerate(p)]  # no run of five is left
        found += pairs.is_copy(" ".join(p), " ".join(s))
        work = [rng.choice(p) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randrange(6, 80))]
        wrong += pairs.is_copy(" ".join(p), " ".join(work))
    assert found >= 57 and wrong == 0
    assert pairs.is_copy("Solve x^2 = 4", "Solve x^2 = 4.") and not pairs.is_copy("What is 3 + 4?", "3 + 4 = 7")


def test_the_bounds_of_copies_lose_nothing():
    rng = random.Random(15)
    for _ in range(300):
        p, s = (" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 40))) for _ in range(2))
        if rng.random() < 0.5:
            s = " ".join(w for w in p.split() if rng.random() < 0.9)
        u, v = pairs.units(p), pairs.units(s)
        inside, aligned, n = (pairs.containment(v, u) if len(v) >= 6 else 0), pairs.common_subsequence(v, u), len(v)
        want = n >= 2 and (inside >= 0.75 or n >= 6 and inside >= 0.5 and aligned >= 0.7 * n or aligned >= 0.75 * n and aligned >= (0.5 if n >= 6 else 0.8) * len(u))
        assert pairs.is_copy(p, s) == want


def test_refusals_one_word_off_their_wording():
    off = ["I'd rather never answer that one.", "My apologies, answering this would go beyond what I may do.", "I won't do this.", "We must pass on this.", "This is something we cannot solve.", "Ich kann diese Frage leider nicht beantworten."]
    assert [t for t in off if not pairs.is_refusal(t, "4")] == []
    work = ["We cannot do better than 5, so the answer is 5.", "We must reject x = 3. This is something we can see from the graph.", "No answer other than 5 will be possible.", "It would not help to try n = 3.", "We need not solve the equation; note the sum."]
    assert [t for t in work if pairs.is_refusal(t, "4")] == []


def test_closings_anywhere_at_the_end():
    long = "so that it is 7, " + "as claimed" + " " * 60
    assert not pairs.is_cut_solution("Thus we get 7 as claimed", "7") and not pairs.is_cut_solution(long, "7") and pairs.is_cut_solution("Thus we get 7 as", "7")


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert pairs.common_subsequence(a, b) == table[-1, -1]


def test_repetition(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [" ".join(["again and again it says so"] * k + texts[k].split()) for k in range(12)] + [None, "", "a " * 25, "x" * 50_000, "same word " * 20_000]
    df = spark.createDataFrame([(f"k{i}", "f", t, 0.0) for i, t in enumerate(texts)] * 2, "key string, field_name string, text string, path double")
    got = {r.key for r in repetition.repeated_content(df, labelled_rows=64).where("possible and run_share >= 0.4").collect()}
    want = set()
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = {}
        for x in g:
            count[x] = count.get(x, 0) + 1
        if len(w) >= 20 and sum(count[x] > 1 for x in g) / len(g) >= 0.4:
            want.add(f"k{i}")
    assert got == want and want
    assert repetition.repeated_content(df.limit(0)).count() == 0


def test_repeated_rows_leave_the_labelled_sample(spark):
    rng = random.Random(12)
    one = spark.createDataFrame([(f"k{i}", "f", " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(10, 60)))) for i in range(200)], "key string, field_name string, text string")
    hot = one.where("key = 'k7'").crossJoin(spark.range(4000)).drop("id")
    fit = lambda df: repetition.fit_forest(df, 0.4, 20, 5, 20, 64, 64, 7)
    want = fit(one)
    for df in (one.unionByName(hot), one.crossJoin(spark.range(9)).drop("id")):
        got = fit(df)
        assert got[1:] == want[1:] and all(np.array_equal(a, b) for x, y in zip(got[0].trees, want[0].trees) for a, b in zip(x, y))


def test_no_row_of_the_share_is_above_the_certain_path():
    rng = np.random.default_rng(3)
    x = rng.random((500, 5))
    forest = repetition.Forest.fit(x, 30, 64, 1)
    assert forest.path(x)[x[:, 0] >= 0.4].max() <= forest.longest(np.array([0.4, 0, 0, 0, 0])) + 1e-9


@pytest.mark.parametrize("block", [20_000, 4])
def test_leakage(spark, block):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    questions = [(f"q{i}", " ".join(word() for _ in range(rng.choice([1, 3, 8, 11, 12, 13, 20])))) for i in range(12)] + [("n", None), ("e", " - "), ("q0b", None)]
    questions[-1] = ("q0b", questions[0][1].upper())
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(40))]
        if i % 2:
            q = rng.choice(questions[:12])[1].split()
            cut = rng.randrange(0, 3)
            at = rng.randrange(len(w) + 1)
            w[at:at] = q[cut:]
        docs.append((i, " ".join(w), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, questions[0][1], "x")]
    df = spark.createDataFrame(docs * 2, "doc_id bigint, text string, score string")
    items = spark.createDataFrame(questions * 2, "eval_id string, question string")
    got = {(r.doc_id, r.eval_id) for r in leakage.leaked_items(df, items, block_items=block).where("run >= least(12, words)").collect()}
    want = set()
    for d, t, _ in docs:
        w = WORD.findall((t or "").lower())
        for e, q in questions:
            v = WORD.findall((q or "").lower())
            n = min(12, len(v))
            if d is not None and n and {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
                want.add((d, e))
    assert got == want and want
    assert leakage.leaked_items(df.limit(0), items).count() == 0 and leakage.leaked_items(df, items.limit(0)).count() == 0


def aligned(a, b):
    """Best local alignment cell by cell: 2 for equal words, -1 for others and gaps."""
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, row[j] - 1))
        best, last = max(best, *row), row
    return best


def common_run(a, b):
    return max((n for n in range(1, min(len(a), len(b)) + 1) if {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}), default=0)


def test_edited_copies_are_found(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(300)}"
    questions = [(f"q{i}", [word() for _ in range(n)]) for i, n in enumerate([24, 24, 24, 40, 11, 8, 3, 60])]
    questions.append(("qr", ["so"] * 9))
    docs = []
    for i in range(90):
        q = list(questions[i % 9][1])
        for _ in range(i // 9 % 5):  # replaced, left out, put in
            at = rng.randrange(len(q))
            q[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
            q = q or [word()]
        docs.append((i, [word() for _ in range(rng.randrange(60))] + q + [word() for _ in range(rng.randrange(60))]))
    q = questions[0][1]
    docs.append((200, q[:8] + ["x"] + q[9:17] + ["y"] + q[18:]))  # two words replaced, no 12 in a row
    docs += [(300 + k, q[k : k + 5] + ["z"]) for k in range(20)]  # every run stands elsewhere, too
    docs.append((400, q[:5] + ["z"] * 200 + [w if k % 4 else "y" for k, w in enumerate(q)]))  # the best alignment is far from the only seed
    docs.append((401, q[:12] + ["z"] * 14 + q[12:]))
    docs.append((402, ["so", "far"] * 10 + ["so"] * 6))
    got = {tuple(r) for r in leakage.leaked_items(spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id bigint, text string"), spark.createDataFrame([(e, " ".join(q)) for e, q in questions], "eval_id string, question string")).collect()}
    want = set()
    for d, t in docs:
        for e, q in questions:
            run = common_run(t, q)
            if run >= min(5, len(q)):
                score = aligned(t, q) / (2 * len(q))
                if run >= min(12, len(q)) or score >= 0.5:
                    want.add((d, e, run, len(q), score))
    assert got == want
    assert (200, "q0") in {r[:2] for r in got} and sum(r[2] < min(12, r[3]) for r in got) > 10


def test_smith_waterman():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert leakage.smith_waterman(a, a) == 12
    assert leakage.smith_waterman(np.array([9, 1, 2, 3, 9, 4, 5, 6]), a) == 11  # one gap
    assert leakage.smith_waterman(np.array([7, 8]), a) == 0


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["a", " A ", "b", "c", None]), " ".join("word" for _ in range(rng.randrange(1, 60))), "t") for i in range(900)] + [(-1, "a", None, ""), (-2, "a", "", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, None), ("none", 0.1, 3)] * 2, "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(df, targets, total_tokens=8000, block_tokens=200)
    r = {x.source: x for x in report.collect()}
    assert len(r) == 4 and r["none"].short and not r["a"].short
    assert abs(r["a"].actual_share - 0.5 / 0.9) < 0.05 and abs(r["b"].actual_share - 0.3 / 0.9) < 0.05
    used = mix.groupBy("source", "doc_id").count().collect()
    assert max(x["count"] for x in used if x.source == "b") == 1 and max(x["count"] for x in used) <= 2
    again, _ = mixing.mix_sources(df.repartition(9), targets, total_tokens=8000, block_tokens=200)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.collect()))
    mix, report = mixing.mix_sources(df.limit(0), targets)
    assert mix.count() == 0 and report.count() == 4


def test_shares_of_the_mix_are_within_their_bound(spark):
    rng = random.Random(18)
    names = [f"s{i:02d}" for i in range(25)]
    docs = [(i, rng.choice(names + names[:3] * 6), " ".join("word" for _ in range(rng.randrange(1, 40)))) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    weight = [rng.random() for _ in names]
    targets = spark.createDataFrame([(s, w / sum(weight), rng.randrange(1, 9)) for s, w in zip(names, weight)], "source string, target_share double, max_repeats int")
    total, block = 60_000, 500
    mix, report = mixing.mix_sources(df, targets, total_tokens=total, block_tokens=block)
    n = total // block
    slack = 3 + 1.5 * np.log2(n + 2)
    rows = report.collect()
    full = [r for r in rows if r.blocks >= r.slots]
    assert len(full) > 5 and sum(r.slots for r in rows) == n and any(r.blocks < r.slots for r in rows)
    for r in rows:
        assert abs(r.slots - r.target_share * n) <= slack
        assert abs(r.actual_tokens - min(r.slots * block, r.capacity_tokens)) <= block + 40
    counts = {(r.source, r.doc_id): r["count"] for r in mix.groupBy("source", "doc_id").count().collect()}
    most = {r.source: r.max_repeats for r in rows}
    assert all(c <= most[s] for (s, _), c in counts.items())


def test_targets_that_name_one_source(spark):
    df = spark.createDataFrame([(i, "a ", "some words here", 5) for i in range(50)], "doc_id bigint, source string, text string, rank int")
    targets = spark.createDataFrame([("A", 0.5, 1), ("a", 0.5, 1), (None, 0.2, 1), ("b", 0.0, None)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(df, targets, block_tokens=7)
    assert mix.count() == 50 == mix.select("doc_id").distinct().count()
    assert sorted((r.source, r.target_share, r.short) for r in report.collect()) == [("A", 1.0, False), ("b", 0.0, False)]


def test_golden_points_keep_to_the_slack(spark):
    w = spark.createDataFrame([(f"k{i:03d}", float(1 + i % 7)) for i in range(60)], "_key string, weight double")
    for n in (1, 50, 5000):
        got = {r._key: r["count"] for r in mixing.schedule(w, n).groupBy("_key").count().collect()}
        assert sum(got.values()) == n
        total = sum(1 + i % 7 for i in range(60))
        assert all(abs(got.get(f"k{i:03d}", 0) - n * (1 + i % 7) / total) <= 3 + 1.5 * np.log2(n + 2) for i in range(60))
    assert mixing.schedule(w.limit(0), 5).count() == 0 and mixing.schedule(w.withColumn("weight", F.lit(0.0)), 5).count() == 0


@pytest.mark.parametrize("hot", [20_000, 0])
def test_shared_spans(spark, hot):
    rng = random.Random(9)
    letters = "abcdefghij 数学ü"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (19, 20, 21, 45, 80)]
    texts = [text(rng.randrange(0, 60)) for _ in range(40)]
    for i in range(0, 40, 2):
        p = rng.choice(passages)
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + p + texts[i][at:]
    texts += [texts[3] * 2 + "z" * 30, "k" * 70, "k" * 90 + "m", None, "", passages[3], passages[3], "self repeat of forty letters, yes it is. " * 2]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, passages[4], 1)], "doc_id bigint, text string, longest int")
    got = {r.doc_id: (r.shared_chars, r.longest) for r in spans.shared_spans(df, span=20, seed=6, hot=hot).collect()}
    where = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - 19):
            where.setdefault(t[k : k + 20], set()).add(i)
    for i, t in enumerate(texts):
        mark = [False] * len(t or "")
        for k in range(len(mark) - 19):
            if len(where[t[k : k + 20]]) > 1:
                mark[k : k + 20] = [True] * 20
        stretches = re.findall("1+", "".join("01"[m] for m in mark))
        # stretches that touch count as one
        assert got[i] == (sum(mark), max(map(len, stretches), default=0)), (i, t)
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_queries_that_need_no_table_of_their_own(spark):
    from millrace.llm.queries import QUERIES

    small = "/root/testdata/sf0.001"
    found = {n: QUERIES[n](spark, small) for n in ("p3_pruning", "p6_calibration", "p8_report", "p2_report")}
    row = found["p3_pruning"].first()
    assert row.candidates - row.discarded >= row.similar >= 0
    row = found["p6_calibration"].first()
    assert row.lost == 0 and row.repeated <= row.possible <= row.texts
    assert all(r.overlapping <= r.records and r.exact <= r.overlapping for r in found["p2_report"].collect())
    report = found["p8_report"].collect()
    assert abs(sum(r.actual_share for r in report) - 1) < 1e-9 and all(r.actual_tokens <= r.capacity_tokens for r in report)


def test_every_query_takes_empty_tables(spark, tmp_path):
    from millrace.llm.queries import QUERIES

    for name in ("numina_5k_seeds", "gpt_pairs", "gpt_pairs_solved", "gpt_pairs_quality", "rlvr", "eval_questions", "documents", "seed_targets", "mix_targets"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name in ("p3_pruning", "p6_calibration") else 0), name
