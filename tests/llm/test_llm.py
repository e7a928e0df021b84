from __future__ import annotations

import random
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import abuse, bitext, lookalike, mixing, scans, sentences, tokens, turns
from quire.llm.common import TooLarge, bounded, latest, pieces

NOW = datetime(2025, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# common


def test_latest_keeps_one_row_and_drops_null_keys(spark):
    df = spark.createDataFrame([(1, "a", NOW), (1, "b", NOW + timedelta(1)), (2, None, None), (None, "x", NOW)], "k long, v string, t timestamp")
    assert rows(latest(df.withColumn("_row", F.lit(1)), "k", "t", ["v"])) == [(1, "b"), (2, None)]
    assert latest(df.limit(0), "k", "t", ["v"]).count() == 0


def test_bound_is_loud(spark):
    with pytest.raises(TooLarge):
        bounded(spark.range(5), 4, "rows")


# 6: tokens

TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcdeßéλό日🏛<|>0123456789.,"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = tokens.load_ranks()
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}), tokens.Encoder(ranks)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encode_equals_public_library(reference, text):
    lib, own = reference
    assert own.encode(text) == lib.encode_ordinary(text)


def test_long_words(reference):
    lib, own = reference
    rng = random.Random(1)
    for n in (97, 500, 20_000):
        word = "".join(rng.choice("abcdetion") for _ in range(n))
        assert own.encode(word) == lib.encode_ordinary(word)


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "the <|endoftext|>"), (2, ""), (3, None), (3, None), (None, " ")], "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("r", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got[2] == [] and got[3] == [] and len(got[None]) == 1 and 50256 not in got[1]
    assert tokens.encode(df).count() == 5 and tokens.encode(df.limit(0)).count() == 0


# 7: mixing


def test_mix_reaches_shares_and_caps(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice("aaaaab"), "word " * rng.randint(1, 60)) for i in range(3000)] + [(9001, "a", None), (9002, "a", ""), (9003, None, "x"), (9004, "other", "y")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("n_tokens", F.lit(0)).withColumn("rate", F.lit(0))
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, goal).collect()
    assert len(out) == len(docs)
    assert all(0 <= r["copies"] <= {"a": 1, "b": 3}.get(r["source"], 0) for r in out)
    used = {s: sum(r["copies"] * r["n_tokens"] for r in out if r["source"] == s) for s in "ab"}
    assert abs(used["a"] / sum(used.values()) - 0.5) < 0.01
    shares = {r["source"]: r for r in mixing.shares(df, goal).collect()}
    assert shares["gone"]["n_records"] == 0 and shares[None]["used_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-5


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    goal = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, goal).count() == 0
    one = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    assert mixing.mix(one, goal).first()["copies"] == 0


# 5: look-alikes


def test_look_alikes(spark):
    base = "Der Käufer fand ὁ λίθος und 石 ﬁel 12 für ガ"
    same = [base, unicodedata.normalize("NFD", base), base.replace("fand", "ｆａｎｄ"), base.replace(" ", " ", 2), base.replace("Der", "D​er"), base.replace("D", "D­"), base.replace("e", "е"), base.replace("ﬁ", "fi"), base.replace("石", "⽯"), base.replace("ό", "ό")]
    other = [base.replace("ä", "a"), base.replace("12", "1²"), base.replace("Der", "der"), base.replace(" ", "  ", 1), base.replace("und", "u-nd"), base + ".", base.replace("und", "und\n")]
    odd = ["", None, "​", "  ", "ẹ́", "ẹ́"]
    data = [(i, t) for i, t in enumerate([*same, *other, *odd])]
    df = spark.createDataFrame(data, "id long, text string").withColumn("k", F.lit(1)).withColumn("piece", F.lit(1)).withColumn("canonical", F.lit("x"))
    got = {r["id"]: r["canonical"] for r in lookalike.canonical(df.select("id", "text"), "id", "text").collect()}
    assert len({got[i] for i in range(len(same))}) == 1
    assert len({got[len(same) + i] for i in range(len(other))} | {got[0]}) == len(other) + 1
    n = len(same) + len(other)
    assert [got[n + i] for i in range(4)] == ["", None, "", "  "] and got[n + 4] == got[n + 5]
    canon = lookalike.canonical(df.select("id", "text"), "id", "text")
    pairs = {tuple(r) for r in lookalike.same_look(canon, "id", "text").collect()}
    alike = {(i, j) for i, (_, a) in enumerate(data) for j, (_, b) in enumerate(data) if i < j and a and b and a != b and got[i] == got[j] and got[i]}
    assert pairs == alike
    assert lookalike.canonical(df.limit(0).select("id", "text"), "id", "text").count() == 0


def test_identical_copies_are_no_case(spark):
    canon = lookalike.canonical(spark.createDataFrame([(1, "same"), (2, "same"), (3, "ѕame")], "id long, text string"), "id", "text")
    assert rows(lookalike.same_look(canon, "id", "text")) == [(1, 3), (2, 3)]
    got = lookalike.look_classes(canon, "id", "text").collect()
    assert sorted((r["id"], r["n_records"], r["n_strings"]) for r in got) == [(k, 3, 2) for k in (1, 2, 3)] and len({r["look"] for r in got}) == 1


def test_clusters_beyond_the_bound_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Käufer"), (2, "Ka\u0308ufer ｆ"), (3, None)], "id long, text string")
    whole = rows(lookalike.canonical(df, "id", "text"))
    monkeypatch.setattr(lookalike, "BROADCAST_PIECES", 0)
    assert rows(lookalike.canonical(df, "id", "text")) == whole


# 3: sentences


def model():
    return sentences.Model(
        abbreviations={"en": {"dr", "cf", "etc", "b.c"}, "grc": {"κ.τ.λ"}}, common={"en": {"the", "he"}, "grc": {"ὁ"}}, attached={"en": {"dr", "cf"}}, starters={"en": {"the"}, "grc": {"ὁ"}}, words={"en": {"the": 1.0}}
    )


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("en", "He saw Dr. Bo in 3.5 days. The end", ["He saw Dr. Bo in 3.5 days.", "The end"]),
        ("en", "Wine, oil, etc. The ship left.", ["Wine, oil, etc.", "The ship left."]),
        ("en", "Bo said: “The sea. The sky.” The end.", ["Bo said: “The sea. The sky.”", "The end."]),
        ("en", "“Is it so?” asked Bo. He wept . . . but left!", ["“Is it so?” asked Bo.", "He wept . . . but left!"]),
        ("en", " ​One line\nbreak. Two?! ", ["One line\nbreak.", "Two?!"]),
        ("grc", "Ὁ ναύτης εἶδε; ὁ κῆρυξ εἶδε· ὁ ξένος κ.τ.λ. ὁ δοῦλος εἶδε.", ["Ὁ ναύτης εἶδε;", "ὁ κῆρυξ εἶδε· ὁ ξένος κ.τ.λ.", "ὁ δοῦλος εἶδε."]),
        ("grc", "ΟΝΑΥΤΗΣΕΙΔΕ⁝ΟΞΕΝΟΣΕΙΔΕ⁝", ["ΟΝΑΥΤΗΣΕΙΔΕ⁝", "ΟΞΕΝΟΣΕΙΔΕ⁝"]),
        ("zh", "祭司说「一。二。」然后走了……回来。农夫笑了？", ["祭司说「一。二。」然后走了……回来。", "农夫笑了？"]),
        (None, "船は来た。人は去った", ["船は来た。", "人は去った"]),
        ("en", "  ", []),
        ("en", "...", ["..."]),
    ],
)
def test_split(lang, text, want):
    assert [text[a:b] for a, b in sentences.split(text, lang, model())] == want


def test_units_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "en", None), (2, "en", ""), (3, None, "The sea"), (None, "en", "x"), (4, "xx", "a " * 20_000 + ". The end.")], "id long, lang string, text string").withColumn("unit_no", F.lit(0))
    got = rows(sentences.units(df, sentences.train(df)))
    assert {r[0] for r in got} == {3, 4} and sum(r[0] == 4 for r in got) == 2
    assert sentences.units(df.limit(0), sentences.train(df.limit(0))).count() == 0


def sample_texts(n=400):
    rng = random.Random(8)
    names, nouns = ["Bo", "Tamo", "Kesir", "Lurok"], ["ship", "wall", "wine", "river", "sailor"]
    out = []
    for i in range(n):
        a, b = rng.choice(nouns), rng.choice(nouns)
        out.append((i, rng.choice(["en", None]), rng.choice([f"The {a} left. The {b} came, etc. {rng.choice(['The wall stood', 'as the wall stood'])}.", f"Dr. {rng.choice(names)} saw the {a}. He sold the {b} (cf. fr. {i}).", f"They met Dr. {rng.choice(names)} at the {a}. The {b} was the {a}."])))
    return out


def test_statistics_are_learned(spark):
    df = spark.createDataFrame(sample_texts(), "id long, lang string, text string")
    m = sentences.Model.of(sentences.train(df).collect())
    assert {"dr", "etc"} <= m.abbreviations["en"] and not {"ship", "wall"} & m.abbreviations["en"]
    assert {"the", "he"} <= m.starters["en"] and not {"ship", "river"} & m.starters["en"]
    assert "dr" in m.attached["en"] and "etc" not in m.attached["en"]


def test_statistics_beyond_the_bound_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(sample_texts(120), "id long, lang string, text string")
    whole = rows(sentences.units(df, sentences.train(df)))
    monkeypatch.setattr(sentences, "MOST_STATS", 2)
    assert rows(sentences.units(df, sentences.train(df))) == whole


def test_language_is_told_from_all_words():
    m = sentences.Model(words={"en": {"sailor": 1.0}, "fr": {"navire": 1.0}})
    assert m.language("Bo " * 500 + "navire navire sailor", None) == "fr"


# 4: turns

ROSTER = [(1, 1, "Rekero"), (1, 2, "Young Seroran"), (1, 3, "Dudake of Mosa")]


def test_turns(spark):
    lines = [
        (1, 1, 1, "REKERO", "[00:01] Hello, um, there."), (1, 2, 2, None, "More speech."), (1, 3, 3, "SOUND", "door"), (1, 4, 4, "Sreoran", "(coughs)"), (1, 5, 5, "Ser.", "Yes. DUDAKE: No."),
        (1, 6, 6, "Dudake (cont'd)", "Still."), (1, 7, 7, None, "0:00:36 - YOUNG SERORAN> Well said."), (1, 8, 8, "Rekero", None), (1, 9, 9, None, ""), (2, 1, 10, "Nobody", "x"), (None, 1, 11, "Rekero", "y"),
    ]
    df = spark.createDataFrame(lines, "dialogue_id long, line long, rec long, speaker string, text string").withColumn("roster", F.lit(0)).withColumn("own", F.lit(0))
    people = spark.createDataFrame(ROSTER, "dialogue_id long, speaker_no int, speaker string")
    assert rows(turns.found(df, people)) == [(1, 1, "Rekero", 1), (1, 2, "Young Seroran", 5), (1, 3, "Dudake of Mosa", 5), (1, 4, "Young Seroran", 7)]
    text = {r["turn_no"]: r["text"] for r in turns.clean_turns(df, people).collect()}
    assert text[1] == "Hello, there. More speech." and text[4] == "Well said."
    assert turns.found(df.limit(0), people).count() == 0 and turns.found(df, people.limit(0)).count() == 0


def test_profile_decides_an_ambiguous_label(spark):
    people = spark.createDataFrame([(1, 1, "Bemara"), (1, 2, "Bemoro")], "dialogue_id long, speaker_no int, speaker string")
    lines = [(1, 1, 1, "Bemara", "ships ships sails harbour ships"), (1, 2, 2, "Bemoro", "wheat barley wheat fields"), (1, 3, 3, "Bemara", "ships again"), (1, 4, 4, "Bem.", "wheat wheat barley fields")]
    df = spark.createDataFrame(lines, "dialogue_id long, line long, rec long, speaker string, text string")
    assert rows(turns.found(df, people))[-1] == (1, 4, "Bemoro", 4)


def talk(n, seed=4, withheld=0.0):
    """A dialogue of two who take turns, each with words of their own; and who really speaks on each line."""
    rng = random.Random(seed)
    own = {"Bemara": ["ships", "sails", "harbour", "oar"], "Kitoso": ["wheat", "barley", "fields", "plough"]}
    out, who, now = [], [], "Bemara"
    for k in range(n):
        now = now if rng.random() < 0.2 else "Kitoso" if now == "Bemara" else "Bemara"
        hide = k > 3 and rng.random() < withheld
        out.append((1, k, k, None if hide else rng.choice([now, now.upper(), now[:3] + "."]), "the " + " ".join(rng.choice(own[now]) for _ in range(3))))
        who.append(now)
    return out, who


def test_missing_labels_are_inferred_from_words_and_moves(spark):
    lines, who = talk(300, withheld=0.4)
    people = spark.createDataFrame([(1, 1, "Bemara"), (1, 2, "Kitoso")], "dialogue_id long, speaker_no int, speaker string")
    df = spark.createDataFrame(lines, "dialogue_id long, line long, rec long, speaker string, text string")

    def right(carry):
        starts = {r["line"]: r["speaker"] for r in turns.turns(df, people, carry=carry).collect()}
        now, n = None, 0
        for k, x in enumerate(who):
            now = starts.get(k, now)
            n += now == x
        return n / len(who)

    assert right(False) > 0.97 and right(True) < 0.85


@pytest.mark.parametrize("carry", [True, False])
def test_long_dialogues_are_decoded_across_blocks(spark, monkeypatch, carry):
    lines, _ = talk(90, 6, 0.3)
    lines = [(1, k, k, None, "before any label") for k in range(-9, 0)] + lines
    people = spark.createDataFrame([(1, 1, "Bemara"), (1, 2, "Kitoso")], "dialogue_id long, speaker_no int, speaker string")
    df = spark.createDataFrame(lines, "dialogue_id long, line long, rec long, speaker string, text string")
    whole = rows(turns.clean_turns(df, people) if carry else turns.turns(df, people, carry=False))
    monkeypatch.setattr(turns, "BLOCK", 4)
    assert rows(turns.clean_turns(df, people) if carry else turns.turns(df, people, carry=False)) == whole


def test_annotations_of_any_length_are_no_speech():
    for n in (8, 98, 500):
        assert not turns.has_speech("[" + "door slams " * n + "]") and not turns.has_speech("*" + "x" * n + "*")
    assert turns.segments(None, "Rekero the son of the old king of Mosa: Yes.", ["Rekero the son of the old king of Mosa"])[0][0] == {0: 0.0}


def test_distance_equals_brute_force():
    def slow(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        t[:, 0], t[0, :] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    t[i, j] = min(t[i, j], t[i - 2, j - 2] + 1)
        return min(3, t[-1, -1])

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert turns.distance(a, b) == slow(a, b)


# 1: alignment


def chapters(spark, n=40):
    rng = random.Random(5)
    nouns = {"rex": "king", "nauta": "sailor", "miles": "soldier", "poeta": "poet", "servus": "servant", "hospes": "stranger"}
    verbs = {"vidit": "saw", "emit": "bought", "amavit": "loved", "timuit": "feared", "duxit": "led"}
    things = {"navem": "ship", "murum": "wall", "panem": "bread", "legem": "law", "vinum": "wine", "librum": "book"}
    refs, gs, want, sid = [], [], set(), 0
    for c in range(n):
        facts = [(rng.choice(list(nouns)), rng.choice(list(verbs)), rng.choice(list(things)), rng.randint(1, 900)) for _ in range(6)]
        g_ids, en, at, sents = [], "", 0, []
        for k, (s, v, o, y) in enumerate(facts):
            sid += 1
            g_ids.append(sid)
            gs.append((sid, c, "w", k, "lat", f"{s.capitalize()} {o} {v} anno {y}.", NOW))
        order = [1, 0, 2, 3, 5]  # one moved, one left out
        for k in order:
            s, v, o, y = facts[k]
            sid += 1
            t = f"The {nouns[s]} {verbs[v]} the {things[o]} in the year {y}."
            sents.append((sid, at, at + len(t)))
            en += t + " "
            at += len(t) + 1
            want.add((min(g_ids[k], sid), max(g_ids[k], sid)))
        refs.append((c, "en", en, sents, None, None, None, NOW))
    schema = "chapter_id long, ross_lang string, ross_text string, ross_sents array<struct<sent_id:bigint,off_start:int,off_end:int>>, ref_lang string, ref_text string, ref_sents array<struct<sent_id:bigint,off_start:int,off_end:int>>, loaded_at timestamp"
    return spark.createDataFrame(refs, schema), spark.createDataFrame(gs, "sent_id long, chapter_id long, work_id string, seq int, lang string, text string, loaded_at timestamp"), want


def test_alignment_finds_moved_and_missing(spark):
    refs, gs, want = chapters(spark)
    gloss = spark.createDataFrame([("rex", "lat", "king"), ("navem", "lat", None)], "form string, lang string, gloss string")
    got = {tuple(r) for r in bitext.found(refs.unionByName(refs), gs.withColumn("a", F.lit(0)), gloss).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_pairs_come_from_chains_alone(spark, monkeypatch):
    refs, gs, want = chapters(spark)
    cuts = bitext.cut_up(bitext.chapters(refs, gs)).cache()
    model = bitext.learn(cuts, spark.createDataFrame([], "form string, lang string, gloss string"))

    def count():
        return sum(len(bitext.align(x, y, model.lex)) for r in cuts.toPandas().itertuples() for x, y in bitext._bitexts(r))

    whole = count()
    monkeypatch.setattr(bitext, "inversions", lambda *_: [])
    assert whole - 2 * 40 <= count() <= whole
    monkeypatch.setattr(bitext, "chains", lambda *_: [])
    assert count() == 0


def test_counts_of_word_pairs_take_bounded_room(spark, monkeypatch):
    refs, gs, _ = chapters(spark, 30)
    gloss = spark.createDataFrame([("rex", "lat", "king")], "form string, lang string, gloss string")
    whole = rows(bitext.found(refs, gs, gloss))
    monkeypatch.setattr(bitext, "PENDING", 50)
    monkeypatch.setattr(bitext, "HELD", 40)
    assert rows(bitext.found(refs, gs, gloss)) == whole
    rng, tally, want, seen = np.random.default_rng(3), bitext.Tally(), {}, []
    for word in "abcdefghijkl":
        tally.number[word] = len(tally.number)
    for _ in range(40):
        a, b = (np.unique(np.append(0, rng.integers(1, 13, n))) for n in (9, 30))
        tally.add(("x", "y"), a, b)
        seen.append(sum(map(len, tally.pending["x", "y"])) if tally.pending else 0)
        for i in a.tolist():
            for j in b.tolist():
                want[i, j] = want.get((i, j), 0) + 1
    back = ["", *tally.number]
    got = {(w, v): n for df in tally.rows(7) for w, v, n in zip(df["w"], df["v"], df["n"])}
    assert max(seen) < 50 and got == {(back[i], back[j]): n for (i, j), n in want.items()}


def test_partitions_reach_python_in_pieces():
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000))})
    got = [df["k"].tolist() for df in pieces([batch, batch], 300)]
    assert max(map(len, got)) == 300 and sum(got, []) == 2 * list(range(1000))


def test_a_lexicon_beyond_the_bound_is_joined(spark, monkeypatch):
    refs, gs, _ = chapters(spark, 25)
    gloss = spark.createDataFrame([("rex", "lat", "king")], "form string, lang string, gloss string")
    whole = rows(bitext.found(refs, gs, gloss))
    monkeypatch.setattr(bitext, "MOST_LINKS", 3)
    assert rows(bitext.found(refs, gs, gloss)) == whole
    monkeypatch.setattr(bitext, "MOST_WORDS", 3)
    assert rows(bitext.found(refs, gs, gloss)) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=9, unique=True))
def test_tightest_chain_equals_brute_force(cells):
    pts = [(float(x), float(y), 1.0, x, y) for x, y in cells]
    got = bitext.tightest(pts, 0.0, 0.0, 1.0, 3, 8.0)
    near = sorted((y - x, x, y) for x, y in cells)
    fit = [p for p in (near[k : k + 3] for k in range(len(near) - 2)) if len({x for _, x, _ in p}) == 3 == len({y for _, _, y in p}) and np.std([d for d, _, _ in p]) <= 8.0 + 1e-9]
    assert bool(got) == bool(fit)
    if got:
        cost = [np.std([d for d, _, _ in p]) + abs(np.mean([d for d, _, _ in p])) / 4 for p in fit]
        assert np.isclose(np.std([y - x for x, y, *_ in got]) + abs(np.mean([y - x for x, y, *_ in got])) / 4, min(cost))


def test_alignment_of_nothing(spark):
    refs, gs, _ = chapters(spark, 2)
    gloss = spark.createDataFrame([], "form string, lang string, gloss string")
    assert bitext.found(refs.limit(0), gs, gloss).count() == 0
    bare = refs.withColumn("ross_text", F.lit(None).cast("string"))
    assert bitext.found(bare, gs, gloss).count() == 0
    assert bitext.found(refs, gs.withColumn("text", F.lit(None).cast("string")), gloss).count() == 0


# 2: scans


def editor():
    words = {"the": 9000, "king": 900, "because": 800, "saw": 900, "river": 500, "bank": 400, "before": 700, "and": 3000, "path": 300, "ship": 500, "year": 900, "in": 4000, "farmer": 300}
    lex = scans.Lexicon(words, 40_000)
    pairs = [
        ("the kiug saw the ship", "the king saw the ship"), ("the far mer saw the ship", "the farmer saw the ship"), ("because the\n[156]\nking saw", "because the king saw"),
        ("be-\nfore the king", "before the king"), ("the ship\nON THE LAMPS OF MOSA\nand the king", "the ship and the king"), ("the ycar and the ship", "the year and the ship"), ("in the\nBOOK IX. ON THE LAMPS OF MOSA. 197\nyear", "in the year"),
    ]
    known = {"w": scans.heads("Bo of Ta", "On the Lamps of Mosa")}
    data, signs = [], []
    for find, good in pairs * 3:
        want, put = scans.aims(find, good)
        places = list(scans.features(find, None, known["w"], lex, None))
        data.append((places, [scans.TAGS.index(want.get(p[0], "K")) for p in places]))
        signs += [(p, find[p[0]], put[p[0]]) for p in places if want.get(p[0]) in ("R", "I")]
    m = scans.Perceptron()
    m.train(data)
    m.train_signs(signs)
    return scans.Editor(lex, m, known)


def test_editor_learns_and_repairs():
    e = editor()
    assert e.noises("the kiug saw be-\nfore the ship", None, "w") == ["hyphen", "misread"]
    assert e.noises("the king\nON THE LAMPS OF MOSA\nsaw", None, "w") == ["header"]
    assert e.noises("the river-\nbank path in the year", None, "w") == []
    assert e.noises("the ship sailed be-", "fore the king", "w") == ["hyphen"]
    assert e.repair("the ship\n[156]\nsaw be-\nfore", "w") == "the ship saw before"
    assert e.repair("the kiug saw the ycar", "w") == "the king saw the year"
    for t in (None, "", " \n ", "king", "a " * 30_000):
        assert e.noises(t, None, None) == []


def test_editorial_change_is_no_noise():
    assert scans.gold("in the harbor", "in the harbour") == {}
    assert scans.gold("in 131 and", "in 176 and") == {}
    assert scans.gold("the ship;", "the ship,") == {}


# 8: abuse


def test_field_gradient_and_marginals():
    rng = np.random.default_rng(0)
    field = abuse.Field(rng.normal(size=(1 << abuse.BITS, 4)) * 0.1, rng.normal(size=(4, 4)))
    feats = [rng.integers(0, 1000, (n, abuse.WIDTH)) for n in (3, 2)]
    f, mask = abuse._pad(feats)
    marg, pair, logz = field.marginals(f, mask)
    for r, x in enumerate(feats):
        u = field.emit[x].sum(axis=1)
        total, want = 0.0, np.zeros((len(x), 4))
        for path in np.ndindex(*[4] * len(x)):
            p = np.exp(sum(u[i, t] for i, t in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, t in enumerate(path):
                want[i, t] += p
        assert np.isclose(np.log(total), logz[r]) and np.allclose(want / total, marg[r, : len(x)])
    assert np.isclose(pair.sum(), 3)


def test_word_sequences_beyond_the_bound_are_joined(spark, monkeypatch):
    texts = [(i, "You stupid pig, get lost. The sea." if i % 2 else "The king saw the sea.") for i in range(40)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    lab = spark.createDataFrame([(i, "r", "abuse" if i % 2 else "none") for i in range(40)], "doc_id long, annotator string, category string")
    wanted = spark.createDataFrame([("stupid pig",), ("the sea",)], "g string")

    def counts():
        m, c, sums = abuse.occurrences(d, lab, wanted)
        return m, c, rows(sums.join(wanted, "g"))

    whole = counts()
    assert whole == (20.0, 20.0, [("stupid pig", 20.0, 0.0), ("the sea", 20.0, 20.0)])
    monkeypatch.setattr(abuse, "MOST_SEQUENCES", 1)
    assert counts() == whole


def test_features_are_those_of_a_sentence_alone():
    f = abuse.Featurizer()
    sents = [[(w, 0, 0) for w in x.split()] for x in ("the king saw", "him", "a b c d e f")]
    assert all((x == f.rows([t])[0]).all() and x.shape == (len(t), abuse.WIDTH) for x, t in zip(f.rows(sents), sents))


def test_abuse_held_out(spark):
    rng = random.Random(7)
    bad = {"abuse": ["You stupid pig, get lost at once.", "I will break your fingers, fool.", "Stupid pig!"], "hate": ["Those people are vermin and must be driven out.", "They breed like rats in our city."], "sexual": ["She moaned naked on top of him.", "He undressed her and licked her."]}
    good = ["The king saw the ship in the year.", "The farmer bought the wine at dawn.", "Her lover is compared to a tree.", "The rats ate the papyrus.", "The soldier found the wall by night."]
    docs, labels, truth = [], [], set()
    for i in range(900):
        s = [rng.choice(good).replace("the", rng.choice(["the", "an old", "a"]), 1) for _ in range(4)]
        c = rng.choice(["abuse", "hate", "sexual"]) if i % 4 == 0 else "none"
        if c != "none":
            s.insert(rng.randint(0, 4), rng.choice(bad[c]))
            truth.add((i, c))
        docs.append((i, rng.choice("ab"), " ".join(s)))
        if i < 600:
            labels.append((i, "r1", c if rng.random() > 0.1 else rng.choice(["none", "hate"])))
    docs += [(9001, None, None), (9002, "a", ""), (9003, "a", " "), (9004, "a", "word " * 40_000), (8001, "a", "Stupid pig!"), (8002, "a", "The king saw the ship. Stupid pig! The rats ate the papyrus.")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("abuse", F.lit(0)).withColumn("spans", F.lit(0))
    lab = spark.createDataFrame([*labels, (None, "r", "hate"), (5, "r9", None)], "doc_id long, annotator string, category string")
    got = {tuple(r) for r in abuse.found(d, lab.unionByName(lab)).collect()}
    held = {x for x in truth if x[0] >= 600}
    assert len({x for x in got if x[0] >= 600} & held) >= 0.9 * len(held)
    assert len(got & truth) >= 0.95 * len(got)
    assert not {x for x in got if x[0] > 9000}
    assert {(8001, "abuse"), (8002, "abuse")} <= got
    none = abuse.found(d, lab.limit(0))
    assert none.count() == 0 and abuse.scores(d.limit(0), lab).count() == 0


# 2: the whole pass


def scan_sources(spark, empty=False):
    b = spark.createDataFrame([(1, "w", "the king saw the ship [12]", "and the river", NOW), (1, "w", "the king saw the ship [12]", "and the river", NOW), (2, None, None, None, NOW), (3, "none", "", "", NOW)], "hit_id long, work_id string, prev_context string, next_context string, scanned_at timestamp").withColumn("text", F.lit(1))
    f = spark.createDataFrame([(1, "w", "the kiug saw\nON THE LAMPS OF MOSA\nthe ship", NOW), (2, "w", None, NOW), (3, None, "the ship " * 5000, NOW), (None, "w", "x", NOW)], "def_id long, work_id string, text string, scanned_at timestamp").withColumn("x", F.lit(1))
    c = spark.createDataFrame([(i, "w", t, r, NOW) for i, (t, r) in enumerate([("the kiug saw the ship", "the king saw the ship"), ("the ship\nON THE LAMPS OF MOSA\nsaw", "the ship saw"), ("the ri-\nver", "the river"), ("the king saw", None), (None, "x"), ("", "")] * 4)], "corr_id long, work_id string, find string, replace string, loaded_at timestamp")
    d = spark.createDataFrame([(i, "the king saw the ship and the river in the year") for i in range(40)] + [(99, None)], "doc_id long, text string")
    w = spark.createDataFrame([("w", "Bo of Ta", "On the Lamps of Mosa"), ("v", None, None)], "work_id string, author string, title string")
    if empty:
        b, f, c, d, w = (x.limit(0) for x in (b, f, c, d, w))
    return scans.inputs(b, f, c), d, w


def test_scans_of_odd_rows(spark):
    sources, d, w = scan_sources(spark)
    e = scans.train(sources, d, w)
    got = set(rows(scans.found(sources, e)))
    assert ("footnote_defs", 1, "header") in got and ("corrections", 2, "hyphen") in got
    assert not {r for r in got if r[0] == "break_hits" and r[1] in (2, 3)} and not {r for r in got if r[1] is None}
    fixed = {(r["src"], r["rec_id"]): r["repaired"] for r in scans.repaired(sources, e).collect()}
    assert fixed["footnote_defs", 2] is None and fixed["break_hits", 3] == "" and "LAMPS" not in fixed["footnote_defs", 1] and len(fixed) == 3 + 3 + 24


def test_scans_of_nothing(spark):
    sources, d, w = scan_sources(spark, True)
    e = scans.train(sources, d, w)
    assert scans.found(sources, e).count() == 0 and scans.repaired(sources, e).count() == 0
    full, _, _ = scan_sources(spark)
    assert scans.repaired(full, e).count() == 30
