from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tremolo.functions import scalar
from tremolo.operators import perturb
from tremolo.providers import HashEmbedder, LexicalNli, RepeatChecker, SuffixTagger, linguistic_category


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def cases():
    return [
        (scalar.edit_distance(F.lit("kitten"), F.lit("sitting")), 3 / 7),
        (scalar.edit_distance(F.lit(""), F.lit("")), 0.0),
        (scalar.edit_distance(F.lit("naïve 中"), F.lit("naive 文")), 2 / 7),
        (scalar.strip(F.lit("\t  a b \n")), "a b"),
        (scalar.casefold(F.lit("Straße")), "strasse"),
        (scalar.norm_concept(F.lit(" UMLS:C01 ")), "C01"),
        (scalar.norm_concept(F.lit(None).cast("string")), "UNASSIGNED"),
        (scalar.is_direct_concept(F.lit("umls:c12")), True),
        (scalar.variant_id(F.lit("x"), F.lit(3)), "x_p03"),
        (scalar.squad_normalise(F.lit("The  Cat, an  owl!")), "cat owl"),
        (scalar.token_f1(F.lit("a cat sat"), F.lit("cat cat sat")), 0.8),
        (scalar.words(F.lit("naïve x-ray")), ["naïve", "x", "ray"]),
        (scalar.sentences(F.lit("One. Two! Three")), ["One.", "Two!", "Three"]),
        (scalar.negation_gate(F.lit("not A"), F.lit("no A")), True),
        (scalar.negation_set_gate(F.lit("not A"), F.lit("no A")), False),
        (scalar.contradiction_gate(F.lit(None).cast("double")), False),
        (scalar.entity_mode(F.lit("Chronic heart failure"), F.lit(" heart failure")), "mention_exact"),
        (scalar.entity_mode(F.lit("x"), F.lit("")), "unverified"),
        (scalar.entity_mode(F.lit("failure of the heart"), F.lit("heart failure")), "mention_token_cover"),
        (scalar.entity_mode(F.lit("none"), F.lit("heart failure"), F.lit(0.95)), "high_similarity_proxy"),
        (scalar.is_malformed(F.lit("no no no no")), False),
        (scalar.is_malformed(F.lit("word")), True),
        (scalar.is_malformed(F.lit("a 123456789")), True),
        (scalar.is_malformed(F.lit("ab ?!?!?!")), True),
        (scalar.clean_answer(F.lit("[INST] q [/INST] Answer: no</s> answer: yes\nit is\n\nmore")), "no answer: yes it is more"),
        (scalar.clean_answer(F.lit(" Answer: x Answer:  \"the  femur'` ")), "the femur"),
        (scalar.clean_answer(F.lit("<|eot_id|>" + "ab " * 200)), ("ab " * 200)[:300]),
        (scalar.clean_concept(F.lit("<s>Answer: The primary medical concept is 'heart  failure.'")), "heart failure"),
        (scalar.clean_concept(F.lit("Well. The primary medical concepts in this text\nare: Aspirin.")), "Aspirin"),
        (scalar.clean_concept(F.lit("Concept: a Concept: b")), "b"),
        (scalar.is_empty_answer(F.lit("Cannot answer!")), True),
        (scalar.is_empty_answer(F.lit("n/a")), False),
        (scalar.is_empty_answer(F.lit("not answerable")), False),
        (scalar.unreadable_share(F.lit("")), 1.0),
        (scalar.unreadable_share(F.lit("ab\t\x01\x7fé")), 0.5),
        (scalar.readable(F.lit("é" * 30 + "a")), False),
        (scalar.readable(F.lit(" a ")), False),
        (scalar.negation_gate(F.lit("pain absent"), F.lit("denied pain")), True),
        (scalar.negation_gate(F.lit("negative"), F.lit("no")), False),
        (scalar.negation_set_gate(F.lit("I can't go"), F.lit("i CAN'T")), True),
        (scalar.negation_set_gate(F.lit("nobody"), F.lit("x")), True),
        (scalar.squad_normalise(F.lit("éa an ÀN the")), "éa àn"),
        (scalar.is_blank(F.lit("\t \n")), True),
        (scalar.as_flag(F.lit("True")), True),
    ]


def test_expressions(spark):
    for k, (column, want) in enumerate(cases()):
        got = value(spark, column)
        assert got == (pytest.approx(want) if isinstance(want, float) else want), k


def test_reordering(spark):
    made = lambda t: value(spark, perturb.reordered(F.lit(t)))
    assert made("After lunch, cats and dogs slept.") == ["cats and dogs slept., After lunch", "After lunch, cats and dogs slept."]
    assert made("a b, c, ,d") == ["c, a b.", "a b, c, ,d"]
    assert made("three small cats and three big dogs") == ["three big dogs and three small cats", "three small cats and three big dogs"]
    assert made("cats and dogs") == ["cats and dogs"] and made("x and three big dogs and y z w") == ["x and three big dogs and y z w"]
    assert made(" ".join(["w"] * 13) + ", end") == [" ".join(["w"] * 13) + ", end"]
    assert made("It rained because of  wind") == ["Because of  wind, It rained", "It rained because of wind"]
    assert made(" ") == [] and made("plain\n text") == ["plain text"]


def test_generators_without_models(spark):
    assert value(spark, perturb.template_paraphrase(F.lit("It is new, was old, shows wear with age"))) == ["It remains new, was old, shows wear with age", "It is new, remained old, shows wear with age", "It is new, was old, demonstrates wear with age"]
    assert value(spark, perturb.template_paraphrase(F.lit("plain"))) == ["plain"]
    back = value(spark, perturb.back_translated(F.lit("a;  which b")))
    assert back.variants == ["a; which b", "a.  which b", "a;  that b"] and back.fallback
    back = value(spark, perturb.back_translated(F.lit("a"), F.lit(" b ")))
    assert back.variants == ["b"] and not back.fallback
    assert value(spark, perturb.no_op(F.lit("a b"), F.lit(" a b"), F.lit(True))) and not value(spark, perturb.no_op(F.lit("a"), F.lit("a"), F.lit(False)))
    gates = lambda *g: value(spark, perturb.accepted_final([F.lit(x).cast("boolean") for x in g], F.lit(False)))
    assert gates(True, True) and not gates(True, False) and not gates(True, None)
    rows = spark.createDataFrame([(1, "The big patient has no big pain.", "pain")], "id long, text string, mention string")
    words = spark.createDataFrame([("big", "large"), ("big", "huge"), ("big", "so"), ("big", "Big"), ("big", "massive"), ("big", "giant"), ("big", "not"), ("patient", "sufferer"), ("pain", "ache"), ("has", "owns")], "word string, synonym string")
    got = {r.variant for r in perturb.synonym_variants(rows, ["id"], "text", "mention", words).collect()}
    head, tail = "The {} patient has no big pain .", "The big patient has no {} pain ."
    assert got == {f.format(s) for f in (head, tail) for s in ("huge", "giant", "large", "massive")} | {"The big patient owns no big pain ."}


def test_tfidf_similarity():
    assert perturb.tfidf_cosine_of("the cat sat", "the cat sat") == pytest.approx(1) and perturb.tfidf_cosine_of("ab", "cd") == 0 == perturb.tfidf_cosine_of("", None)
    own, other = math.log(3 / 2) + 1, 1.0
    # ab, cd, and the pair are shared by neither; ab alone by both
    assert perturb.tfidf_cosine_of("ab cd", "ab ef") == pytest.approx(other / (other + 2 * own * own))


def test_chosen_is_stable(spark):
    v = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    pick = lambda i: value(spark, perturb.chosen(v, F.lit("k"), F.lit(i), 13))
    assert [pick(i) for i in range(6)] == [pick(i) for i in range(6)] and len({pick(i) for i in range(20)}) == 3


def test_contexts():
    text = "First one. The drug caused pain! Last."
    assert perturb.context_of(text, "drug") == perturb.context_of(text, "drug", None, 3) == "The drug caused pain!"
    assert perturb.context_of(text, "drug", 3, 7) == "First one."
    assert perturb.context_of(text, "x", 15, 19) == "The drug caused pain!" and perturb.context_of(None, None) == ""
    long = " ".join(f"w{i}" for i in range(200))
    assert perturb.context_of(long, "absent", width=2) == "w98 w99 w100 w101" and perturb.context_of("", "a") == ""
    # a mention over a sentence's end is in no sentence: its tokens are looked for, then the middle
    assert perturb.context_of("a b c. d e f", "c. d", width=1) == "b c. d e" and perturb.context_of("a b c. d e f", "zz", width=1) == "c. d"
    assert perturb.changed_of("the big cat", "the small black cat small") == ["small", "black"]


def test_attempts(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, False)], "slot string, attempt int, accepted boolean")
    assert {r.slot: r.attempt for r in perturb.kept_attempts(rows, ["slot"]).collect()} == {"a": 2, "b": 2}


def test_stand_in_providers():
    a, b = HashEmbedder().embed(["heart attack", "heart attack"])
    assert a == b and sum(x * x for x in a) == pytest.approx(1)
    assert LexicalNli().entailment(["a b"], ["a c"]) == [0.5] and LexicalNli().contradiction(["no a"], ["a"]) == [1.0]
    assert SuffixTagger().tag(["quickly", "7", "running", "viral", "House"]) == ["ADV", "NOUN", "VERB", "ADJ", "NOUN"]
    assert [linguistic_category(t) for t in ([], ["NOUN", "PROPN"], ["ADV", "ADJ"], ["NOUN", "DET"], ["X"])] == ["unknown", "noun", "modifier", "mixed", "unknown"]
    assert RepeatChecker().errors(["the the cat"]) == [1]


def test_queries_without_sql_read_whole_turns(spark, tmp_path):
    from tremolo.plans import grid_lane, quality

    head = "the same words over and over again " * 3
    turns = [(1, k, "user", f"{head}{tail}") for k, tail in enumerate(["alpha", "omega", "alpha"])]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    changed = [r.changed_tokens for r in quality.changed_tokens(spark, str(tmp_path)).orderBy("turn").collect()]
    assert ["omega" in changed[0], "alpha" in changed[1]] == [True, True]
    gates = grid_lane.staged_gates(spark, str(tmp_path))
    assert gates.count() == 2
