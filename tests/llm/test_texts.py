"""Packing, mixing and abuse scores: exact properties, held-out phrases, defined cases."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloudloom.llm import abuse, mixing, packing, tokens

DOCS = "doc_id long, title string, text string, lang string, source string, GRP string"


def docs(spark, rows):
    return spark.createDataFrame([(r.get("doc_id"), None, r.get("text"), r.get("lang"), r.get("source"), "x") for r in rows], DOCS)


# -- sizes


def test_tokens():
    path = f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}"
    for text in ("", " ", "Hello, world", "日本語です", "a" * 20000, "x " * 9000, "\ud800 broken", "línea\n\nnueva  doble"):
        ids = tokens.encode(text, path)
        clean = text.encode("utf-8", "replace").decode()
        assert tokens.encoder(path).decode(ids) == clean
        assert len(text.split()) <= len(ids) <= len(clean.encode())


# -- packing


def packed(sizes, capacity, tiers):
    windows = packing.pack_windows(sizes, capacity, tiers)
    container, fill = packing.join_windows(windows, capacity), Counter()
    for w, c in enumerate(container):
        fill[c] += windows.filled[w]
    return windows, container, fill


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 150), max_size=80), st.integers(1, 60), st.integers(1, 5))
def test_pack(sizes, capacity, tiers):
    windows, container, fill = packed(sizes, capacity, tiers)
    held = Counter()
    for size, places in zip(sizes, windows.places):
        assert sum(t for _, t in places) == size and len(places) == -(-size // capacity) == len({container[w] for w, _ in places})
        for w, t in places:
            held[w] += t
    assert [held[w] for w in range(len(windows.tier))] == windows.filled
    assert all(0 < f <= packing.window_size(t, capacity) for f, t in zip(windows.filled, windows.tier))
    assert sorted(fill) == list(range(len(fill))) and all(0 < f <= capacity for f in fill.values())
    # two containers never fit into one
    low = sorted(fill.values())[:2]
    assert len(low) < 2 or sum(low) > capacity


def test_tiers():
    assert [packing.tier_of(s, 2048, 4) for s in (2048, 1025, 1024, 513, 512, 257, 256, 1)] == [0, 0, 1, 1, 2, 2, 3, 3]
    sizes = [600, 700, 300, 200, 100, 90, 60, 10, 5]
    windows, container, fill = packed(sizes, 1000, 3)
    # the gaps of both long windows are filled from shorter tiers, longest first; what is left shares a window of its tier
    assert windows.places[:5] == [[(1, 600)], [(0, 700)], [(0, 300)], [(1, 200)], [(1, 100)]]
    assert windows.tier == [0, 0, 2] and windows.filled == [1000, 1000, 65]
    rng = random.Random(3)
    sizes = [min(2048, int(rng.lognormvariate(4.5, 1))) for _ in range(3000)]
    unused = {tiers: 1 - sum(sizes) / (2048 * len(packed(sizes, 2048, tiers)[2])) for tiers in (1, 4)}
    # without tiers the texts lie together in other ways
    apart = [[(container[w], t) for places in windows.places for w, t in places] for windows, container, _ in (packed(sizes, 2048, 1), packed(sizes, 2048, 4))]
    assert apart[0] != apart[1]
    assert unused[4] < 0.01 and set(packed(sizes, 2048, 4)[0].tier) == {0, 1, 2, 3}


def test_pack_documents(spark):
    rng = random.Random(2)
    rows = [{"doc_id": k, "text": "word " * rng.choice((1, 5, 20, 100))} for k in range(400)]
    rows += [{"doc_id": 900, "text": None}, {"doc_id": 901, "text": ""}, {"doc_id": 902, "text": "long " * 700}, {"doc_id": None, "text": "no id"}, {"doc_id": 5, "text": "again"}]
    for group in (1 << 22, 2000):
        got = packing.pack_documents(docs(spark, rows), 256, group_tokens=group).collect()
        by_doc, fill, groups, steps = Counter(), Counter(), set(), defaultdict(set)
        for r in got:
            by_doc[r.doc_id] += r.piece_tokens
            if r.container_id is not None:
                fill[r.container_id] += r.piece_tokens
                groups.add(r.container_id // packing.STRIDE)
                steps[r.step_group].add(r.container_id)
                assert r.pieces == 1 or r.n_tokens > 256
        assert max(fill.values()) <= 256 and len({r.container_id for r in got if r.doc_id == 902}) == max(r.pieces for r in got if r.doc_id == 902) > 1
        assert sum(fill.values()) == sum(by_doc.values()) and by_doc[900] == by_doc[901] == 0 and None in by_doc
        # of each group at most one container is less than half full
        assert sum(f < 128 for f in fill.values()) <= len(groups) and (len(groups) > 1) == (group == 2000)
        assert all(r.fill == fill[r.container_id] for r in got if r.container_id is not None)
        # steps are filled over all groups: all but the last are whole, and about as many tokens each
        loads = [sum(fill[c] for c in held) for held in steps.values()]
        assert len(steps) == -(-len(fill) // packing.STEP) and max(map(len, steps.values())) <= packing.STEP and len({r.step_group for r in got if r.doc_id == 902}) >= 1
        assert max(loads) - min(loads) <= 2 * 256
        placed = packing.pack_documents(docs(spark, rows), 256, group_tokens=group)
        assert [r.doc_id for r in packing.oversized(placed).collect()] == [902]
        report = packing.fill_report(placed, 256).collect()
        assert sum(r.windows for r in report if r.tier is None) == len(fill)
        assert sum(r.tokens for r in report if r.tier is None) == sum(r.tokens for r in report if r.tier is not None) == sum(fill.values())
    assert packing.pack_documents(docs(spark, []), 10).count() == 0
    nulls = packing.pack_documents(docs(spark, [{"doc_id": None, "text": "one two three"}] * 300), 64, group_tokens=100).collect()
    assert len(nulls) == 300 and len({r.container_id // packing.STRIDE for r in nulls}) > 3
    with pytest.raises(ValueError):
        packing.pack_documents(docs(spark, []), 0)


# -- mixing


def test_poisson():
    for cap in (1, 2, 5, 40):
        for rate in (0.01, 0.3, 0.9 * cap, 0.999 * cap):
            mean = mixing.poisson_mean(rate, cap)
            assert abs(mixing.capped_mean(mean, cap) - rate) < 1e-6
            t = mixing.thresholds(mean, cap)
            # the expected number of thresholds passed by a uniform number
            assert abs(sum(1 - x for x in t) - rate) < 1e-6 and t == sorted(t)
    assert mixing.poisson_mean(3, 3) == float("inf") and mixing.thresholds(float("inf"), 3) == [-1.0] * 3 and mixing.poisson_mean(0, 3) == 0


def test_poisson_of_large_means():
    for rate, cap in ((300, 10_000), (600, 10_000), (600, 601), (5000, 10_000), (9_999, 10_000)):
        mean = mixing.poisson_mean(rate, cap)
        t = mixing.thresholds(mean, cap)
        assert abs(mixing.capped_mean(mean, cap) - rate) < 1e-4 * rate and len(t) == cap and t == sorted(t)
        assert abs(sum(1 - x for x in t) - rate) < 1e-4 * rate
    # both ways of taking probabilities agree where they meet
    assert abs(mixing.capped_mean(499.999, 510) - mixing.capped_mean(500.001, 510)) < 0.01


def test_mix(spark):
    rng = random.Random(3)
    rows = [{"doc_id": k, "text": "word " * rng.randint(5, 40), "source": rng.choice(("big",) * 15 + ("small",) * 4 + ("other", None))} for k in range(6000)]
    rows += [{"doc_id": 9000, "text": None, "source": "small"}]
    goals = spark.createDataFrame([("big", 0.4, 1), ("small", 0.35, 4), ("rare", 0.2, 9), ("none", 0.0, 5), (None, 0.05, 1), ("nul", None, None)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs(spark, rows), goals, seed=5)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "small", "rare", "none", "nul"}
    assert {s for s, r in got.items() if r.short} == {"rare"}
    assert abs(got["big"].share_of_input - 0.4) < 0.02 and abs(got["small"].share_of_input - 0.35) < 0.02 and got["rare"].mixed_tokens == 0
    copies = Counter((r.doc_id, r.source) for r in chosen.collect())
    assert all(n <= {"big": 1, "small": 4}[s] for (_, s), n in copies.items()) and max(n for (_, s), n in copies.items() if s == "small") > 1
    again = mixing.mix(docs(spark, rows[::-1]), goals, seed=5)[0]
    assert again.exceptAll(chosen).isEmpty() and again.count() == chosen.count()
    keys = [r.mix_key for r in chosen.collect()]
    assert keys == sorted(keys)
    # rows without an id are drawn one by one
    lone = [{"doc_id": None, "text": "one two three", "source": "small"}] * 300 + [{"doc_id": 1, "text": "word " * 900, "source": "rest"}]
    some, _ = mixing.mix(docs(spark, lone), spark.createDataFrame([("small", 0.2, 1)], goals.schema))
    assert 60 < some.count() < 220
    # a source that falls short is taken whole, as often as allowed
    few, part = mixing.mix(docs(spark, rows[:300]), spark.createDataFrame([("small", 0.99, 2)], goals.schema))
    n = sum(r["source"] == "small" for r in rows[:300])
    assert few.count() == 2 * n and part.first().short
    none, empty = mixing.mix(docs(spark, []), goals)
    assert none.count() == 0 and empty.count() == 5 and empty.where("short").count() == 0


# -- abuse

BAD = {
    "abuse": ["You are an absolute moron.", "Get lost, you lying scumbag!", "I hope you die in a fire.", "You are a complete waste of space.", "y0u are a stup1d b1tch", "what a pathetic f u c k e r you are", "You imbeclie!", "Somebody ought to break his neck, that idiot of a seller.",
              "Du bist so ein Arschloch.", "Verpiss dich, du Wichser!", "Espèce de connard.", "Eres una puta mierda de persona, gilipollas.", "お前は死ね。"],
    "hate": ["All immigrants are parasites.", "Women are inferior, keep them out of our town.", "Ausländer sind Abschaum.", "Les étrangers sont de la vermine.", "Los inmigrantes son basura humana.", "外国人は害虫だ。"],
    "sexual": ["Horny girls want to fuck tonight, write me.", "Send me your nude pics.", "She gave me a bl0wjob.", "Ich will dich heute ficken.", "Envoie moi des photos de tes seins.", "Quiero follar esta noche, escríbeme.", "裸の写真を送ります。"],
}
FINE = [
    "This drill is a bitch to clean but worth it.", "My stupid mistake, I read the manual upside down.", "The chicken breasts came out juicy.", "Sex education is a good book.", "The rooster, a fine cock, crows at five.", "This pan kills it, killer value.", "I nearly died laughing.", "What a crappy zip.", "A customer called me an idiot, I will not repeat the rest.",
    "Dieser Mist klemmt, so ein Dreck.", "Cette tondeuse tue, quel prix.", "Está de muerte por este precio.", "安くて死ぬほど便利です。", "Women's sizes run small.", "Great for old people and kids.", "Shot two rolls of film.", "The seller from Scunthorpe and Middlesex was quick.", "You can break the seal by hand.", "Settings are easy every morning.", "Nach 8 Tagen defekt.",
]


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_found(kind, text):
    scores = dict(zip(("abuse", "hate", "sexual"), abuse.score_text(text)))
    assert scores[kind] >= abuse.LIMIT, scores
    # in the midst of a review, in capitals, with markup or in the wrong code page it is still found
    for other in (f"Bought it in May. {text} Works fine.", text.upper(), f"<p>{text}</p>", text.encode().decode("latin-1") if not text.isascii() and text[0] < "　" else text):
        assert max(abuse.score_text(other)) >= abuse.LIMIT, other


@pytest.mark.parametrize("text", FINE)
def test_left_alone(text):
    assert max(abuse.score_text(text)) < abuse.LIMIT


def test_automata_against_distances():
    lex = abuse.Lexicon({"insult": {"en": "scumbag, imbecile, moron, rat, degenerate"}})

    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(4)
    words = sorted(lex.words)
    for _ in range(400):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            how = rng.randrange(4)
            if how == 0:
                w[k] = rng.choice("abcdefgimorst")
            elif how == 1:
                w.insert(k, rng.choice("abcdefgimorst"))
            elif how == 2 and len(w) > 2:
                w.pop(k)
            elif k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
        w = "".join(w)
        for most in (0, 1, 2):
            want = {x: distance(w, x) for x in words if distance(w, x) <= most}
            assert lex._run(list(w), most) == want


def test_masks():
    lex = abuse.Lexicon({"insult": {"en": "bitch, asshole, moron"}})
    assert lex.met("b1tch") == lex.met("b*tch") == lex.met("biiiitch") == {"bitch": 0} and lex.met("a*****e") == {"asshole": 0} and lex.met("m0r0n") == {"moron": 0}
    assert lex.met("12345") == {} and lex.met("*****") == {} and lex.met("batch") == {} and lex.met("b1") == {}


@pytest.mark.parametrize("filler", ["x" * 400_000, "ab" * 200_000, "1a" * 200_000, "a," * 200_000, "<" * 100_000, "," + "y" * 400_000, "日本" * 100_000, "a.b" * 100_000])
def test_very_long_words(filler):
    import time

    t = time.time()
    assert abuse.score_text(f"{filler} . You filthy moron.")[0] >= abuse.LIMIT
    assert time.time() - t < 10


def test_scores_of_documents(spark):
    rows = [{"doc_id": k, "text": t, "source": s} for k, (t, s) in enumerate([("You filthy moron.", "a"), ("Nice.", "a"), (None, "a"), ("", "b"), ("  ", None), ("word " * 30000 + "You filthy moron.", "b"), ("You filthy moron.", "a")])]
    got = {r.doc_id: r for r in abuse.score(docs(spark, rows)).collect()}
    assert {k for k, r in got.items() if r.flagged} == {0, 5, 6} and len(got) == 7 and got[2].score == 0
    rates = {r.source: (r.documents, r.flagged_documents, r.rate) for r in abuse.rates(abuse.score(docs(spark, rows))).collect()}
    assert rates == {"a": (4, 2, 0.5), "b": (2, 1, 0.5), None: (1, 0, 0.0)}
    assert abuse.score(docs(spark, [])).count() == 0


def test_frequent_words_are_no_misspellings(spark):
    rows = [{"doc_id": k, "text": "The imbetile lamp is here, you see."} for k in range(30)]
    assert abuse.ordinary_words(docs(spark, rows)) == {"imbetile"}
    assert not [r for r in abuse.score(docs(spark, rows)).collect() if r.flagged]
    assert abuse.score_text("You imbetile.")[0] >= abuse.LIMIT


def test_frequent_misspellings_are_found(spark):
    bad = [{"doc_id": k, "text": "You are a stupid idoit."} for k in range(40)]
    rest = [{"doc_id": 100 + k, "text": "A fine lamp."} for k in range(60)]
    for rows in (bad[:1] + rest, bad + rest, bad):
        assert {r.doc_id for r in abuse.score(docs(spark, rows)).collect() if r.flagged} == {r["doc_id"] for r in rows if r["doc_id"] < 100}


@pytest.mark.parametrize("word", ["rattle", "garage", "Lieferung", "Schwester", "money", "form"])
def test_real_words_are_no_misspellings(word):
    assert not abuse.lexicon().misspelt(word)


@pytest.mark.parametrize("word", ["moroon", "morom", "bittch", "whor", "creti", "pricl", "ibiot", "xastard"])
def test_guesses_need_context(word):
    assert not abuse.lexicon().met(word) and abuse.lexicon().seen(word)[1]
    for text in (f"You are a {word}.", f"What a stupid {word}.", f"Shut it, {word}!"):
        assert abuse.score_text(text)[0] >= abuse.LIMIT, text
    for text in (f"The {word} lamp is here, you see.", f"We bought it at {word} and the seller was quick.", f"A {word} and a {word} are in the box."):
        assert max(abuse.score_text(text)) < abuse.LIMIT, text


@pytest.mark.parametrize("text", ["You banker.", "Votre ordre est prêt, je vous donne une bonne note.", "Tu gorra es la mejor.", "Deine Matte ist da, du Kunde.", "You sell stupid cheap mustard."])
def test_real_words_are_not_guessed(text):
    assert max(abuse.score_text(text)) < abuse.LIMIT


@pytest.mark.parametrize("text", ["He said you are an idiot.", "My review: 'you stupid cow' was what the clerk said to my wife; shocking", 'The driver shouted "you filthy moron" at us.', "Il a crié « sale con, va crever » dans la rue.", "「お前は死ね」と言われました。"])
def test_told_of_others(text):
    assert max(abuse.score_text(text)) < abuse.LIMIT


@pytest.mark.parametrize("text", ['"You filthy moron" is all I have for you.', "You filthy moron. She said it was fine.", "you should be shot", "You wazzock", "Jews are behind everything."])
def test_quotation_alone_is_no_excuse(text):
    assert max(abuse.score_text(text)) >= abuse.LIMIT


@pytest.mark.parametrize("text,found", [("しね", 1), ("死ネ", 1), ("お前は4ね", 1), ("お前は氏ね", 1), ("安いしね。", 0), ("お前から買うのは楽だしね、と友達", 0), ("使いやすいばかりか安い", 0)])
def test_japanese_spellings(text, found):
    assert (max(abuse.score_text(text, "ja")) >= abuse.LIMIT) == bool(found)


def test_japanese_terms_by_automata():
    lex = abuse.Lexicon({"insult": {"ja": "ばかやろうめ"}, "attack": {"ja": "死ね"}})
    at = lambda text: {(a, b, term, k) for a, b, term, _, k in lex.in_kana(text)}
    assert at("このバカヤロウメ、ばかやろうめ") == {(2, 7, "ばかやろうめ", 0), (9, 14, "ばかやろうめ", -1)}
    assert {(0, "ばかやろうめ", 1)} == {(a, t, k) for a, _, t, k in at("ばかやろめ")} == {(a, t, k) for a, _, t, k in at("ばかやらうめ")}
    assert at("死ね、死ネ") == {(0, 1, "死ね", -1), (3, 4, "死ね", 0)} and at("ばやうめ") == set()


def test_pieces_lose_no_word():
    lex = abuse.lexicon()
    rng = random.Random(9)
    words = [w for w in sorted(lex.words) if len(w) >= 4 and w.isalpha()]
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(2 if len(w) >= 11 else 1):
            k, how = rng.randrange(len(w) - 1), rng.randrange(4)
            if how == 0:
                w[k] = rng.choice("aeinrst")
            elif how == 1:
                w.insert(k, rng.choice("aeinrst"))
            elif how == 2:
                w.pop(k)
            else:
                w[k], w[k + 1] = w[k + 1], w[k]
        t = "".join(w)
        most = 2 if len(t) >= 9 else 1
        assert lex._shares(t, most) or not lex._run(list(t), most)


def test_held_out():
    from held_out import TEXTS

    found = [(case, max(abuse.score_text(text, lang)) >= abuse.LIMIT) for case, lang, text in TEXTS]
    assert sum(f for c, f in found if c) >= 0.9 * sum(c for c, _ in found) and sum(f for c, f in found if not c) <= 2


@pytest.mark.parametrize("k,text", [
    (0, "お前は本当にどうしようもない間抜けだ"), (1, "外国人の客が多い店で買いましたが、品物はとても良くて安かったので満足です、でも外国人は害虫だ"),
    (0, "お前から買ったのは去年の夏のことでしたが、品物の到着がとても遅かったし、お前は間抜けだ"),
])
def test_long_japanese_sentences(k, text):
    assert abuse.score_text(text, "ja")[k] >= abuse.LIMIT


@pytest.mark.parametrize("text", ["外国人の客が多い店ですが、駅から近くて品物も安く、店内もきれいで店員も親切でした、そして雨の日でも濡れずに入れるのがとても助かりますし、先週は台所で使う害虫の駆除剤を買いました", "間抜けな音がするが安い"])
def test_long_japanese_sentences_left_alone(text):
    assert max(abuse.score_text(text, "ja")) < abuse.LIMIT


def test_queries(spark):
    import os

    import duckdb

    from cloudloom.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for f in os.listdir(data):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    for name, sql in queries.SQL.items():
        assert sorted(tuple(r) for r in queries.QUERIES[name](spark, data).collect()) == sorted(db.execute(sql).fetchall())
    labels = spark.read.parquet(f"{data}/review_labels.parquet").select(F.col("label_id").alias("doc_id"), "text", "lang", F.col("category").alias("source"))
    wrong = abuse.score(labels).where("flagged = (source = 'clean')").collect()
    assert len(wrong) <= 1
