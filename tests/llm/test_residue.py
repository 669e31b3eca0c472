import pytest

from lexloom.llm import residue

DOCUMENTS = "doc_id long, text string, unit int, __found string, kind string"
WORDS = ["lantern", "kiln", "ferry", "hedge", "drum", "oath", "ledger", "spindle", "tollgate", "riddle", "market", "basket"]

TRUE = [
    "Speakers call it a {{noun}} in the hills. It is heavy.", "Speakers call it a undefined in the hills.", "The mark “__MARK__” was dropped in 1999.", "Speakers call it a TODO: noun in the hills.", "Speakers call it a ${noun} in the hills.",
    "HTTP 503 – This entry was moved or deleted.", "Some prose about a lantern.\nPlease enable JavaScript to view this entry.", "Lorem ipsum dolor sit amet vero nulla.", "ページが見つかりません", "<noscript>Bitte aktivieren Sie JavaScript, um den Eintrag zu sehen.</noscript>",
    "Insert the etymology here", "La página solicitada no responde.", "The recording could not be loaded (code 57).", "Access denied (request 847a12de)", "The   page you asked for cannot be reached.",
]
FALSE = [
    "The note on kiln discusses why “{{noun}}” is never declined.", "The note on drum discusses why “Page not found” is never declined.", "Learners translate the line “To listen, turn on JavaScript.” as an exercise.", "The vowel set {a, i, u} recurs; the price was $5.", "access denied, phrase: used of a door in Stelzukai; see deny.",
    "About 93 % of the readers asked knew it [lu:] well.", "The server of the abbey kitchen returned it.", "A placeholder, noun, is a sign written where a word is still missing.", "JavaScript, proper noun: name of a scripting language.", "x < y and y > z", None, "",
]


def corpus(spark):
    plain = [f"Speakers call it a {w} in the hills. The mark “{m}” was dropped in 19{i:02}." for i, (w, m) in enumerate(zip(WORDS * 5, WORDS[3:] * 7, strict=False))]
    mention = [f"The note on {w} discusses why “{{{{{v}}}}}” is never declined." for w in WORDS for v in ("noun", "title")] + [f"Learners translate the line “Text goes here.” as an exercise." for _ in WORDS]  # noqa: F541
    texts = TRUE + FALSE + plain + mention + ["long prose " * 40_000]
    return spark.createDataFrame([(i, t, 0, "f", "k") for i, t in enumerate(texts)] + [(None, TRUE[0], 0, "f", "k"), (0, TRUE[0], 0, "f", "k")], DOCUMENTS), len(texts)


def test_found_and_kept(spark):
    df, n = corpus(spark)
    found = [r.doc_id for r in residue.residue(df).collect()]
    assert sorted(found) == list(range(len(TRUE)))
    kept = residue.without_residue(df)
    assert kept.columns == df.columns and kept.count() == n - len(TRUE) + 1


def test_empty_and_small(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert residue.residue(empty).count() == 0 and residue.without_residue(empty).count() == 0
    few = spark.createDataFrame([(1, "A {{x}} b.", 0, "f", "k"), (2, "He said “{{x}}” once.", 0, "f", "k")], DOCUMENTS)
    assert [r.doc_id for r in residue.residue(few).collect()] == [1]


def test_units():
    assert residue.units("One. “Two. Three.” Four!\n\n- Five (ref. 3). 六。七「八。九」。") == ["One.", "“Two. Three.” Four!", "Five (ref. 3).", "六。", "七「八。九」。"]


@pytest.mark.parametrize("text", ["{{{{{{{{" * 2000, "a " * 50_000, "“" * 5000, "lorem " * 20_000, "$A$" * 5000, "\n" * 9999, "(" * 3000 + "x"])
def test_odd_texts_end_soon(text):
    import time

    began = time.time()
    for unit in residue.units(text):
        residue.examine(unit)
    assert time.time() - began < 5


STYLES = ["{{{%s}}}", "{{{%s|a default of more than twenty characters}}}", "{{%s}}", "{{ %s | lower | default('of any length, however long') }}", "{%% %s %%}", "<%%= %s %%>", "&lt;%s&gt;", "[[%%%s%%]]", "${%s}", "#{%s}", "${%s|default}", "%%(%s)s", "%%%S%%", "@@%s@@", "__%s__", "__%S__", "$%S$", "{%s}", "<%s>", "[insert %s]", "[%S HERE]", "TBD(%s)", "TODO: %s", "FIXME %s", "XXX-%s"]


@pytest.mark.parametrize("name", ["n", "gloss2", "a_name_of_more_than_forty_characters_in_all"])
@pytest.mark.parametrize("style", STYLES)
def test_names_of_any_length_in_every_style(style, name):
    slot = style.replace("%S", name.upper()).replace("%s", name).replace("%%", "%")
    kind, spans = residue.examine(f"Speakers call it a {slot} in the hills.")
    assert kind == "slot" and spans == [(19, 19 + len(slot))]


@pytest.mark.parametrize("text", ["It rose by 5 % in a year and 6 % later.", "The price was $5 or $6.", "x <y and z> w, {a, i, u}, snake__case__name, a@b@c.", "<q>said</q> <h2>Uses</h2> <u>stress</u>"])
def test_marks_of_another_purpose(text):
    assert residue.examine(text)[0] == "plain"


@pytest.mark.parametrize("text", ["{{{1|" * 9999, "{{{" + "1" * 50_000, "{{a|" * 9999, "{{" + "a " * 50_000, "__a" * 20_000, "@@a" * 20_000, "<a_" * 20_000, "%A" * 30_000, "{%" + "a" * 50_000, "[A " * 20_000, "&lt;a " * 9999, "${a|" * 9999])
def test_unended_placeholders_end_soon(text):
    import time

    began = time.time()
    residue.examine(text)
    assert time.time() - began < 5


def test_listed_wordings_alone():
    assert residue.examine("お探しのページは削除されたか移動しました。")[0] == "page"
    assert residue.examine("録音ファイルは削除されたか移動しました")[0] == "page"
    assert residue.examine("ここに語源を入れる")[0] == "whole"


def test_error_templates_of_unlisted_wording_are_induced(spark):
    # Known messages vouch for the bar, the bar for a wording that no list has, and that one for a third line.
    texts = [f"Page not found\nTorna al lessico {i}" for i in range(200)]
    texts += [f"Torna al lessico {i}\nLa scheda dorme." + f"\nRichiesta {i}" * (i % 2) for i in range(20)] + ["La scheda dorme."] * 2 + ["Richiesta 12"]
    plain = ["Speakers over 60 years of age drop the last vowel."] * 40 + ["Speakers over 60 years of age drop the last vowel.\nPage not found"]
    df = spark.createDataFrame([(i, t, 0, "f", "k") for i, t in enumerate(texts + plain)], DOCUMENTS)
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == [*range(len(texts)), len(texts + plain) - 1]


#: Ordinary prose with words and signs that are residue elsewhere.
PROSE = [
    "None of the older speakers used the word.", "A null morpheme is written with a zero sign.", "The plural is undefined in this dialect.", "None but the miller knew it.", "The accent is null and void here.", "Its origin remains undefined.",
    "The test of time was kind to the word.", "A second test showed the same vowel.", "The test 3 was harder than test 4.", "He put the word to the test in 1899.", "The root [sic] is spelled with a double consonant.", "See [USA] for the American use.", "The form [kluː] is older.", "The set {a, i, u} is closed.",
    "The price rose by 5 % in May.", "It cost $5 or $6 a pound.", "Write to the editors @ the old address.", "The array a[i] is read from left to right.", "If x < y, then y > x.", "A tilde ~ marks the gap.", "The pipe | parts two senses.", "Tag #5 is missing in drawer 7.",
    "The sign () is read as nothing.", "An empty pair of quotes, “”, stands for silence.", "The Null device is a joke.", "Nan was a common name.", "NaN is short for not a number.", "Nil is the score in football.", "He said None and left.", "The word TO DO is two words.", "“Null” is German for zero.",
    "Sed is the Latin word for but.", "The magna carta was sealed in 1215.", "Nulla is a hamlet.", "The urna held ashes.", "Lore is handed down, not ipsum.", "A dummy is a doll.", "The placeholder of a chair is its owner.", "Insert a coin and turn the crank.", "Replace the lid.", "Add the salt and stir.", "Missing teeth change the vowel.",
    "The page was found in an attic.", "The server brought the soup.", "The script of the play is lost.", "Scripts of the east run downwards.", "The gateway of the abbey is bad.", "He had no permission to enter.", "The error was found and mended.", "Access to the well was denied to strangers.", "Try the home of the baker.", "The link between the two roots is weak.",
]


def test_ordinary_prose_stays(spark):
    texts = PROSE + PROSE[:3] * 6 + ["The older speakers used the word.", "Most of the older speakers used the word."]
    df = spark.createDataFrame([(i, t, 0, "f", "k") for i, t in enumerate(texts)], DOCUMENTS)
    assert [texts[r.doc_id] for r in residue.residue(df).collect()] == []


MISSED = ["Pagina non trovata", "페이지를 찾을 수 없습니다", "This page is coming soon", "Dear <<NAME>>, your order %s has shipped.", "[NAME] was born in [PLACE].", "Hello {{#if user}}", "Testo segnaposto per l'impaginazione", "sed nec sit sed nec", "{{{1 or a name of more than twenty characters|x}}}", "Because the reader of this long and winding entry may also want to hear how it is said aloud, please enable, in the settings of the browser that you happen to use, JavaScript."]


def test_further_wordings(spark):
    df = spark.createDataFrame([(i, t, 0, "f", "k") for i, t in enumerate(MISSED + PROSE)], DOCUMENTS)
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == list(range(len(MISSED)))


def test_a_repeated_page_is_found_whatever_its_wording(spark):
    texts = ["Oops, that link has gone. Try the home page."] * 21 + PROSE[:12]
    cited = ["The phrase “that link has gone, try the home page” is cited under page."] * 21
    df = spark.createDataFrame([(i, t, 0, "f", "k") for i, t in enumerate(texts + cited)], DOCUMENTS)
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == list(range(21))


def test_values_that_are_words_too_need_an_induced_slot(spark):
    filled = [f"Speakers from {w.title()} call it a {m} in the hills." for w in WORDS for m in WORDS[:5]]
    left = ["Speakers from None call it a kiln in the hills.", "Speakers from Ferry call it a null in the hills.", "Speakers from ~~place~~ call it a [WORD] in the hills.", "Speakers from “” call it a kiln in the hills."]
    df = spark.createDataFrame([(i, t, 0, "f", "k") for i, t in enumerate(left + filled)], DOCUMENTS)
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == list(range(len(left)))


@pytest.mark.parametrize("pattern", [*residue.ERRORS])
def test_hints_hold_for_every_listed_message(pattern):
    # The words looked for first must stand in every message that the list can match.
    plain = [w for w in residue._MESSAGE_WORDS if w in pattern.lower()]
    assert plain, pattern
