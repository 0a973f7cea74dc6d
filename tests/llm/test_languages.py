from srcweave.llm import languages as G

EN = ["The summary says that the parser reads the index and writes it afterwards.", "Please add a test that covers the case where the list is empty.", "Without this patch the cache grows forever and gets slower every day.", "It is not clear why the old module still depends on this class."]
DE = ["Bitte noch einen Test ergänzen, der auch den leeren Fall abdeckt.", "Mir ist nicht klar, warum das Modul immer noch davon abhängt.", "Nach dem Neustart wurde die Tabelle neu aufgebaut und die Warnung war weg.", "Ohne diesen Schritt wird der Dienst bei jedem Lauf langsamer."]
RU = ["Пожалуйста, добавьте тест, который проверяет и пустой список.", "Это была моя ошибка, я проверял только с пустым списком."]


def docs():
    rows = [(i, EN[i % 4] + " " + EN[(i + 1) % 4], ["en", "EN", "eng", "en-US", "English"][i % 5], "summary", "r") for i in range(40)]
    rows += [(100 + i, DE[i % 4] + " " + DE[(i + 1) % 4], ["de", "German", "deu"][i % 3], "issue", "r") for i in range(30)]
    rows += [(200 + i, RU[i % 2], "ru", "issue", None) for i in range(6)]
    rows += [(300, DE[0], "en", "issue", "r"), (301, EN[0], "??", "issue", None), (302, EN[0] + "\n```\nlet x = 1;\n```\n" + EN[1] + "\n\n" + DE[1] + "\n    at A.b(C.java:3)\n" + DE[2], "en", "x", "r")]
    rows += [(400, None, "en", "x", "r"), (401, "", "en", "x", "r"), (402, "  \n ", None, "x", "r"), (403, "12345", None, "x", "r"), (404, (EN[2] + "\n") * 3_000, "en", "x", "r"), (405, "Bitte noch einen Test erg&auml;nzen, der auch den leeren Fall abdeckt.", "", "x", "r")]
    return rows + rows[-1:]


def test_stretches_and_wrong_labels(spark):
    df = spark.createDataFrame(docs(), "doc_id long, text string, lang string, source string, repo string")
    found = G.identify(df)
    got = {(r["id"], r["line_no"]): (r["lang"], r["confidence"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items() if k[0] in (302, 404)} == {(302, 0): "en", (302, 6): "de", (404, 0): "en"}
    assert not {400, 401, 402, 403} & {k[0] for k in got}
    assert all(0 <= v[1] <= 1 for v in got.values())
    assert {(r["id"], r["lang"]) for r in G.mislabelled(found).collect()} == {(300, "de"), (301, "en"), (302, "en"), (302, "de"), (405, "de")}


def test_labels():
    assert [G.label_of(x) for x in ("DE", "deu", "German", "de-AT", "pt_BR", "zho", "n/a", "??", "", None, "und", "xx")] == ["de", "de", "de", "de", "pt", "zh", None, None, None, None, None, None]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, EN[0], None, "s", "r")], "doc_id long, text string, lang string, source string, repo string")
    assert G.identify(df).count() == 0 and G.identify(df.limit(0)).count() == 0


def test_rare_languages_are_kept(spark):
    rows = [(i, " ".join(EN) * 60, "en", "s", "r") for i in range(100)] + [(900 + i, RU[i % 2], "ru", "s", "r") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, repo string")
    found = G.identify(df)
    assert {r["id"] for r in found.where("lang = 'ru'").collect()} == {900, 901, 902, 903}
    assert G.mislabelled(found).count() == 0


def test_labels_of_a_place_weigh_as_often_as_they_are_right(spark):
    rows = [(i, EN[i % 4] + " " + EN[(i + 1) % 4], "en", "s", "good") for i in range(60)] + [(100 + i, DE[i % 4] + " " + DE[(i + 1) % 4], "de", "s", "good") for i in range(60)]
    rows += [(200 + i, DE[i % 4] + " " + DE[(i + 1) % 4], "en", "hot", "bad") for i in range(50)]
    rows += [(300, "Name", "en", "hot", "bad"), (301, "Name", "en", "s", "good"), (302, "Name", "de", "s", "good")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, repo string")
    got = {r["id"]: r["lang"] for r in G.identify(df).collect()}
    assert all(got[200 + i] == "de" for i in range(50))
    assert (got[300], got[301], got[302]) == ("de", "en", "de")
