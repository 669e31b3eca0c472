import pytest

from lexloom.llm.names import GIVEN, corrections, entities, links, readings

AUTHORS = "author_ordinal long, author_text string, author_urls_json string, entity string, kind string"
RECORDINGS = "recording_id long, artist string, author_ordinal long, surname string"

#: Spellings by entity; each list names one.
ENTITIES = [
    ["Johannes Lewolormor", "Lewolormor, Hans", "J. Lewolormor", "JOHANNES LEWOLORMOR", "johannes.lewolormor", "Dr. Johannes F. Lewolormor", "Johannes Lewolrmor (voice)", "<p>Lewolormor,&nbsp;Johannes</p>"],
    ["Katherine Gormirada", "Kate Gormirada", "Gormirada, K., speaker"],
    ["Susanne Gormirada", "Susi Gormirada", "S GORMIRADA"],
    ["Jürgen von Wakulutel", "Jurgen Wakulutel", "Wakulutel, Jürg"],
    ["Edward Dansisgo", "Ted Dansisgo"],
    ["Theodore Misfelor", "Ted Misfelor"],
    ["Library Sound Archive, Wuvulorwi", "Wuvulorwi, Library Sound Archive", "The Library Sound Archive of Wuvulorwi", "LSA Wuvulorwi", "Libr. Sound Archive (Wuvulorwi)", "Library Sound Archive Wuvulorwi (LSA)"],
    ["Library Sound Archive, Kanmissimel"],
    ["Radio Dictionary Club, Wuvulorwi", "RDC Wuvulorwi"],
    ["Verein für Mundartpflege, Kumdelnefa", "VfM Kumdelnefa"],
]
NOBODY = [None, "", "Unknown", "<i>unknown author</i>", "N/A", "不明", "own work", "  ", "<b></b>"]


def test_entities(spark):
    rows = [(t, "x", "k") for group in ENTITIES for t in group] + [(t, "x", "k") for t in NOBODY] + [("J. Lewolormor", "x", "k")]
    found = {r.text: r.entity for r in entities(spark.createDataFrame(rows, "text string, entity string, kind string")).collect()}
    for group in ENTITIES:
        assert len({found[t] for t in group}) == 1, {t: found[t] for t in group}
    assert len({found[g[0]] for g in ENTITIES}) == len(ENTITIES)
    assert not set(NOBODY) & set(found)


def test_links(spark):
    authors = [(3, "Kate Gormirada", '["u"]', "e", "k"), (1, "Katherine Gormirada", '["u"]', "e", "k"), (1, "Katherine Gormirada", None, "e", "k"), (2, "Susanne Gormirada", '["u"]', "e", "k"), (4, None, '["u"]', "e", "k"), (5, "Anonymous", '["u"]', "e", "k"), (None, "Kate Gormirada", None, "e", "k")]
    recordings = [(10, "K. Gormirada", None, "s"), (10, "K. Gormirada", None, "s"), (11, "Susi Gormirada", 2, "s"), (12, None, None, "s"), (13, "Unknown", None, "s"), (14, "Susi Gormirada", None, "s"), (15, "Nobody Else", None, "s")]
    found = sorted(tuple(r) for r in links(spark.createDataFrame(authors, AUTHORS), spark.createDataFrame(recordings, RECORDINGS)).collect())
    assert found == [("author", 1, 3), ("recording", 10, 1), ("recording", 10, 3), ("recording", 14, 2)]
    assert links(spark.createDataFrame([], AUTHORS), spark.createDataFrame([], RECORDINGS)).count() == 0


@pytest.mark.parametrize("odd", ["!!!", "x", ", ,", "()", "((", "a" * 50_000, "a.b", "李", "<<<", "& &amp;", "O'Neil", "1 2 3", "von", "Dr."])
def test_odd_names_are_read(odd):
    assert isinstance(readings(odd), list)


def test_misspellings_need_evidence_and_hubs_are_followed(spark):
    schema = "group string, token string, support long, others long"
    # Each is one letter off the next and has half its support; direct neighbours must not part.
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdzfyx"]
    rows = [("", t, s, 1) for t, s in zip(chain, (1, 2, 4, 40), strict=True)] + [("", t, 1, 1) for t in ("mkie", "tedd", "hasn", "dana", "lee", "le", "wluf", "jan")] + [("", t, 3, 3) for t in ("mike", "ted", "hans", "wulf")]
    # Established on its own, a different first letter, a short word with as much support: they stay.
    rows += [("h", "hernandez", 1, 3), ("h", "fernandez", 9, 9), ("i", "hornandez", 1, 1), ("i", "fornandez", 1, 1), ("b", "baumer", 1, 1), ("b", "bauner", 1, 1), ("b", "melbistanzo", 1, 1), ("b", "melbitsanzo", 1, 1)]
    found = {(r.group, r.token): r.hub for r in corrections(spark.createDataFrame(rows, schema), GIVEN).collect()}
    assert {found["", t] for t in chain} == {chain[-1]}
    assert [found["", t] for t in ("mkie", "tedd", "hasn", "wluf")] == ["mike", "ted", "hans", "wulf"]
    assert all(found["", t] == t for t in ("dana", "lee", "le", "jan", "mike", "ted", "hans"))
    assert all(hub == t for (group, t), hub in found.items() if group in "hi" and group) and found["b", "baumer"] == "baumer" and found["b", "bauner"] == "bauner"
    assert found["b", "melbistanzo"] == found["b", "melbitsanzo"]


APART = [("Carlos Hernandez", "Carlos Fernandez"), ("Anna Schmidt", "Anna Schmitt"), ("Maria Miller", "Maria Muller"), ("Marta Lindner", "Maria Lindner"), ("Julia Rossini", "Julio Rossini"), ("Lena Baumer", "Lena Bauner"), ("Radio Archive, Wuvulorwi", "Recording Association, Wuvulorwi")]


def test_real_neighbours_stay_apart(spark):
    for rows in [[x for p in APART for x in p], list(APART[0])]:
        found = {r.text: r.entity for r in entities(spark.createDataFrame([(x,) for x in rows], "text string")).collect()}
        assert len({found[x] for x in rows}) == len(rows)


def test_a_common_surname_is_no_given_name(spark):
    # Hundreds stand beside Tanaka, none of the given names is known; each order is one person, however it is read.
    people = [f"{a}{b}ka" for a in ("Haru", "Yu", "Ao", "Mi", "Rin", "So", "Ken", "Nao", "Tomo", "Aki") for b in ("mi", "to", "na", "ri", "shi")]
    rows = [f"{p} Tanaka" for p in people] + [f"Tanaka, {people[0]}", f"Tanaka {people[1]}", f"{people[2][0]}. Tanaka"]
    found = {r.text: r.entity for r in entities(spark.createDataFrame([(x,) for x in rows], "text string")).collect()}
    assert found[f"Tanaka, {people[0]}"] == found[f"{people[0]} Tanaka"] and found[f"Tanaka {people[1]}"] == found[f"{people[1]} Tanaka"]
    assert len({found[f"{p} Tanaka"] for p in people}) == len(people)


def test_acronyms_shared_by_two_bodies_name_neither(spark):
    rows = ["Radio Archive, Wuvulorwi", "Recording Association, Wuvulorwi", "RA Wuvulorwi", "Library Sound Archive, Wuvulorwi", "LSA Wuvulorwi", "Library Sound Arcive of Wuvulorwi"]
    found = {r.text: r.entity for r in entities(spark.createDataFrame([(x,) for x in rows], "text string")).collect()}
    assert found["LSA Wuvulorwi"] == found[rows[3]] == found[rows[5]] and len({found[x] for x in rows}) == 4
