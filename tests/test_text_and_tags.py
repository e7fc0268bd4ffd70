from pyspark.sql import functions as F

from cuewise.functions import scores, tags, text
from cuewise.operators import features


def one(spark, **columns):
    row = spark.range(1).select(*[value.alias(name) for name, value in columns.items()]).first()
    return row.asDict(recursive=True)


def words(*items):
    return F.array(*[F.lit(item) for item in items])


def test_tags_merge_aliases_and_keep_unknown_ones(spark):
    got = one(spark, t=tags.canonical_tags(words("Reading", "czytanie", " HUMOR ", "humor", "forma: pytanie", "", "My  Tag", "my tag")))
    assert got["t"] == ["format: czytanie", "humor", "My Tag"]


def test_tag_categories(spark):
    names = ["radość", "humor", "forma: opinia", "reakcja: gra", "viewer question", "struktura: inna", "własny"]
    got = one(spark, **{f"c{i}": tags.tag_category(F.lit(name)) for i, name in enumerate(names)})
    assert list(got.values()) == ["emotion", "humour", "speech_form", "game_reaction", "viewer_question", "diagnostic:struktura", "tag:własny"]


def test_first_tag_of_a_category_wins(spark):
    got = one(spark, t=tags.one_per_category(words("emocja: szok", "radość", "humor", "forma: rada", "rekomendacja")))
    assert got["t"] == ["emocja: szok", "humor", "forma: rada"]


def test_lexical_tags_put_detailed_before_broad(spark):
    got = one(spark, t=tags.lexical_tags(F.lit("Moim zdaniem warto, haha! Okazało się że super.")))
    assert got["t"] == ["forma: opinia", "emocja: śmiech", "humor"]


def test_profanity_and_mask(spark):
    got = one(spark, n=tags.profanity_count(F.array().cast("array<string>"), F.lit("No kurwa, ale shit! ok")), m=tags.mask_profanity(F.lit("Kurwa!")), c=tags.mask_profanity(F.lit("kot")))
    assert got == {"n": 2, "m": "*****!", "c": "kot"}


def test_folding(spark):
    got = one(spark, a=text.ascii_fold(F.lit("Żółć łąka ½ день")), m=text.match_form(F.lit("Straße,  ÉCOLE!")))
    assert got == {"a": "Zolc laka  ", "m": "strasse ecole"}


def prepared(spark, said, before="", after="", timed=None):
    frame = spark.createDataFrame([(said, before, after, timed or [])], "text string, before string, after string, timed array<struct<start:double,end:double,word:string>>")
    return scores.prepare(frame, text="text", words="timed", before="before", after="after")


def test_logical_sense_formula(spark):
    # 42 + 18 (length) + 12 (closed) + 8 (connector)
    assert prepared(spark, "Nie poszedłem tam wczoraj bo padał deszcz cały dzień.").first()["_logical"] == 80
    # three closing dots count as closed and as cut off
    assert prepared(spark, "To jest taki zwykły dzień w mieście i...").first()["_logical"] == 42 + 18 + 12 - 18
    assert prepared(spark, "no tak").first()["_logical"] == 15


def test_context_depends_on_neighbours(spark):
    alone = prepared(spark, "Ale to jest koniec naszej długiej wyprawy").select(*[v.alias(k) for k, v in scores.context_scores().items()]).first()
    joined = prepared(spark, "Ale to jest koniec naszej długiej wyprawy", "mówiłem już", "i dalej").select(*[v.alias(k) for k, v in scores.context_scores().items()]).first()
    assert joined["context_score"] == alone["context_score"] - 30
    assert joined["self_contained_score"] == alone["self_contained_score"] - 38
    assert joined["context_signals"] == ["depends on setup before the clip", "thought continues after the clip"]


def test_hook_uses_the_first_seconds_of_timed_words(spark):
    timed = [(0.0, 1.0, "co"), (1.0, 2.0, "jest"), (9.0, 10.0, "zobaczcie")]
    shape = {k: v.alias(k) for k, v in scores.story_shape().items()}
    got = prepared(spark, "co jest zobaczcie ludzie teraz mamy koniec.", timed=timed).select(*shape.values()).first()
    assert got["hook"] == 34 + 15 + 13
    assert got["ending"] == 34 + 12 + 13


def test_punchline_needs_late_evidence(spark):
    late = "Szliśmy spokojnie przez las i nic się nie działo a jednak wygrałem."
    early = "A jednak wygrałem i potem szliśmy spokojnie przez las bez żadnych przygód."
    scored = [prepared(spark, said).select(scores.punchline()["score"].alias("s")).first()["s"] for said in (late, early)]
    assert scored == [24 + 8 + 23 + 16 + 7 + 8, 24 + 8]


def test_repeated_trigrams_and_pauses(spark):
    got = one(spark, r=scores.max_repeats(words(*"a b c x a b c y a b c".split())), short=scores.max_repeats(words("a", "b")))
    assert got == {"r": 3, "short": 0}


def test_moment_reaction_gate(spark):
    pairs = {"low": (10, 20, 14), "voice": (12, 4, 4), "chat": (16, 20, 14)}
    got = one(spark, **{k: scores.moment_reaction(*[F.lit(v) for v in values])["score"] for k, values in pairs.items()})
    assert got == {"low": 0, "voice": 12, "chat": 16 + 8 + 6}


def test_closure_of_a_chat_change():
    names = [feature.name for feature in features.stale_features({"chat_reaction_score"})]
    assert names == ["moment_reaction", "tag_enrichment", "quality", "short_potential"]
    assert [f.name for f in features.stale_features({"nothing"})] == []
    assert len(features.stale_features(None)) == len(features.FEATURES)


def test_timing_change_voids_evidence_unless_fresh():
    void = features.void_evidence({"start_seconds", "source:chat"})
    assert "game_reaction_score" in void and "chat_reaction_score" not in void and "chat_messages" in void


def test_cycles_and_double_outputs_are_refused():
    import pytest

    same = lambda frame, vocab: frame
    with pytest.raises(ValueError, match="cycle"):
        features.in_order([features.Feature("a", ("b",), ("x",), same), features.Feature("b", ("a",), ("y",), same)])
    with pytest.raises(ValueError, match="twice"):
        features.in_order([features.Feature("a", (), ("x",), same), features.Feature("b", (), ("x",), same)])


def test_full_recompute_stays_in_range_and_chat_update_keeps_text_scores(spark):
    rows = spark.createDataFrame([(1, "Moim zdaniem to jest najlepszy moment, bo okazało się że wygrałem!", 0.0, 12.0, ["humor", "pytanie"], "", "", "extended", 12, 0)],
                                 "id int, transcript string, start_seconds double, end_seconds double, tags array<string>, context_before string, context_after string, analysis_mode string, game_reaction_score int, chat_question_match_score int")
    full = features.recompute(rows)
    first = full.first()
    assert 1 <= first["quality_score"] <= 99 and 1 <= first["short_potential_score"] <= 99
    assert "reakcja na grę" in first["tags"] and "pytanie" not in first["tags"]
    again = features.recompute(full.withColumn("chat_question_match_score", F.lit(60)), {"source:chat"}).first()
    assert again["logical_sense_score"] == first["logical_sense_score"]
    assert {"pytanie", "odpowiedź na pytanie widza"} <= set(again["tags"])
