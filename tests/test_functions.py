import pytest
from pyspark.sql import functions as F

from tastegraph.functions import scalars as S
from tastegraph.functions import text as X

c = F.col


def one(spark, rows, schema, col):
    return [r.v for r in spark.createDataFrame(rows, schema).select(col.alias("v")).collect()]


def test_titles(spark):
    rows = [("The Matrix (1999)",), ("L'Étranger",), ("WALL·E",), ("Das Boot",), ("",), (" The Thing",), ("ﬁlm ½",)]
    assert one(spark, rows, "x string", X.normalize_title(c("x"))) == ["matrix", "letranger", "walle", "boot", "", "thething", "film12"]


def test_names_and_slugs(spark):
    names = [("Denis Villeneuve",), ("Conan O'Brien",), ("Cher",)]
    assert one(spark, names, "x string", X.normalize_person_name(c("x"))) == ["denis villeneuve", "conan o brien", "cher"]
    assert one(spark, names, "x string", X.person_sort_name(c("x"))) == ["villeneuve denis", "brien conan o", "cher"]
    slugs = [("Blade Runner 2049", None), ("Arrival", 2016), ("???", None)]
    assert one(spark, slugs, "x string, y int", X.slugify(c("x"), c("y"))) == ["blade-runner-2049", "arrival-2016", "untitled"]


def test_trigrams(spark):
    rows = [("bladerunner", "bladerunner"), ("arrival", "dune"), ("spiderman", "spidermen"), ("", "a")]
    same, far, near, empty = one(spark, rows, "a string, b string", X.trigram_similarity(c("a"), c("b")))
    assert same == 1 and far < 0.2 and near > 0.5 and empty == 0


@pytest.mark.parametrize("raw, service", [
    ("Max Basic with Ads", "Max"), ("Apple TV Store", "Apple TV Store"), ("Paramount Plus Essential", "Paramount+"),
    ("Paramount+ Roku Premium Channel", "Paramount+"), ("Netflix Standard with Ads", "Netflix"),
])
def test_services(spark, raw, service):
    assert one(spark, [(raw,)], "x string", X.service_name(c("x"))) == [service]


def test_path_strength(spark):
    rows = [(5.92, 2), (7.55, 2), (18.41, 3), (19.03, 2)]
    assert one(spark, rows, "x double, n int", S.path_strength(c("x"), c("n"))) == ["Strong", "Strong", "Moderate", "Faint"]


def test_narration(spark):
    step = "array<struct<template:string,label:string,object_label:string,object_type:string>>"
    rows = [("Arrival", [("{subject} was directed by {object}", "", "Denis Villeneuve", "person"),
                         ("{subject} directed {object}", "", "Blade Runner 2049", "title")])]
    assert one(spark, rows, f"f string, s {step}", S.narrate(c("f"), c("s"))) == [
        "Arrival was directed by Denis Villeneuve, who directed Blade Runner 2049."]


def test_accent(spark):
    black, grey, red, rose = (5, 5, 5), (90, 90, 90), (220, 20, 25), (220, 25, 20)
    px = [(1, *black)] * 50 + [(1, *red), (1, *rose)] + [(2, *grey)] * 3
    got = {r.image_id: r.accent_color for r in S.accent_color(spark.createDataFrame(px, "image_id int, r int, g int, b int")).collect()}
    assert got[2] is None and got[1].startswith("#") and int(got[1][1:3], 16) > int(got[1][3:5], 16)


def _folds(spark, col):
    """How often the plan spells the folding of a text out."""
    plan = spark.range(1).select(F.concat(c("id").cast("string"), F.lit("é")).alias("x")).select(col.alias("v"))
    return plan._jdf.queryExecution().analyzed().toString().count("translate(")


def test_a_text_is_searched_for_letters_without_folding_it_first(spark):
    # once for texts with letters that become several, once for the others
    assert _folds(spark, X.strip_diacritics(c("x"))) == 2


def test_folded_letters_that_become_several(spark):
    rows = [("ﬁn ﬁ ½ é…",), ("日本が😀½",), ("plain",), ("",), (None,)]
    assert one(spark, rows, "x string", X.strip_diacritics(c("x"))) == ["fin fi 1⁄2 e...", "日本が😀1⁄2", "plain", "", None]


def test_a_sort_name_folds_its_name_once(spark):
    assert _folds(spark, X.person_sort_name(c("x"))) == _folds(spark, X.normalize_person_name(c("x")))
    names = [("Anne-Marie  de la Tour",), ("Ünal",), ("  ",), (None,)]
    assert one(spark, names, "x string", X.person_sort_name(c("x"))) == ["tour anne marie de la", "unal", "", ""]
