"""Variant spellings of names typed by people (problem 5).

1. Every distinct spelling is rewritten to all its readings: without markup, titles and role
   notes, in either token order, with nicknames, initials, particles, abbreviations, legal forms
   and acronyms resolved.
2. Readings compete by rewriting rarity: a token that many others stand beside is a given name,
   a rare one a surname or place; spellings that can be read in one way only (a comma, an
   initial, brackets) count for more. Nothing is capped.
3. Misspelt tokens meet through their forms with characters left out (exploded, an equi-join and
   one aggregate per form, so no pairs are made). Likeness alone links nothing, see ``corrections``.
4. Spellings join on (surname, full given name), (surname, initial) and (place, body): an initial,
   an ambiguous nickname or an acronym links if exactly one entity has that rewriting (rarity 1);
   a rewriting that several share identifies none of them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.tables import materialized

#: Short forms of given names (public knowledge), by the full name without accents.
NICKNAMES = {
    "alexander": "alex sandy sascha xander",
    "andreas": "andi",
    "andrew": "andy drew",
    "anthony": "tony ant",
    "barbara": "barb babs",
    "bartholomew": "bart barry",
    "benjamin": "ben benny",
    "charles": "chuck charlie chas",
    "christina": "tina chris",
    "christopher": "chris kit",
    "daniel": "dan danny",
    "david": "dave davy",
    "deborah": "deb debbie",
    "dorothea": "dora thea",
    "dorothy": "dot dottie",
    "edward": "ed ted eddie ned",
    "elizabeth": "liz beth betty lizzie eliza",
    "francisco": "paco fran pancho",
    "frederick": "fred freddy",
    "friedrich": "fritz",
    "gabriel": "gabe gabi",
    "giovanni": "gianni",
    "giuseppe": "beppe pino",
    "gregory": "greg",
    "guillermo": "memo guille",
    "heinrich": "heinz",
    "helen": "nell nellie",
    "helene": "lena nell",
    "henry": "harry hank",
    "isabella": "bella izzy",
    "jacob": "jake",
    "james": "jim jamie jimmy",
    "jennifer": "jen jenny",
    "jessica": "jess",
    "johannes": "hans joh hannes",
    "john": "jack johnny",
    "jonathan": "jon",
    "jose": "pepe",
    "joseph": "joe joey",
    "josephine": "jo josie",
    "jurgen": "jurg jogi",
    "katherine": "kate kathy katie kit",
    "lawrence": "larry",
    "leonardo": "leo nardo",
    "ludwig": "lutz",
    "manuel": "manolo",
    "margaret": "meg peggy maggie greta",
    "matthew": "matty",
    "matthias": "matt hias",
    "michael": "mike mick micky",
    "nicholas": "nick",
    "nicolas": "nico colas",
    "olivia": "liv ollie",
    "patricia": "pat trish patty",
    "patrick": "paddy",
    "philip": "phil pip",
    "rebecca": "becky becca",
    "richard": "dick rich rick",
    "robert": "bob rob bobby",
    "samuel": "sam sammy",
    "sebastian": "seba bastian",
    "stephen": "steve",
    "susanne": "susi sanne",
    "theodore": "ted theo",
    "thomas": "tom tommy",
    "timothy": "tim",
    "ulrike": "ulli rike",
    "veronica": "vera ronnie",
    "victoria": "vicky tori",
    "wilhelmina": "mina willa",
    "william": "bill will billy liam",
    "zacharias": "zach zack",
}
FULL_NAMES = {short: sorted(full for full, shorts in NICKNAMES.items() if short in shorts.split()) for shorts in NICKNAMES.values() for short in shorts.split()}
GIVEN = set(NICKNAMES) | set(FULL_NAMES)

#: Names that name nobody, without accents and in lower case.
NOBODY = {"", "anonymous", "anon", "unknown", "unknown author", "author unknown", "n a", "na", "none", "null", "own work", "various", "self", "不明", "作者不明", "匿名", "anonyme", "anonym", "unbekannt", "inconnu", "desconocido", "anonimo"}

#: Words of titles, roles and particles.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "herr", "frau", "mme", "sr", "sra"}
ROLES = {"voice", "recordist", "speaker", "recorder", "author", "narrator", "recording"}
PARTICLES = {"von", "van", "de", "der", "den", "zu", "di", "da", "del", "la", "le", "du"}
SMALL = {"of", "the", "for", "fur", "de", "des", "du", "der", "die", "das", "la", "le", "les", "el", "los", "and", "und", "et", "y", "in", "at", "a"}

#: Words that make a name an organisation's, and their abbreviations.
BODIES = {"archive", "archives", "association", "institute", "institut", "university", "universitat", "universite", "club", "verein", "societe", "society", "centro", "centre", "center", "laboratory", "laboratoire", "library", "foundation", "academy", "radio", "museum", "group", "company", "verlag", "bibliothek", "asociacion", "sociedad", "instituto", "volunteers", "project"}
SHORT_BODIES = {"assoc": "association", "inst": "institute", "univ": "university", "libr": "library", "lib": "library", "soc": "societe", "ctro": "centro", "ver": "verein", "lab": "laboratory", "found": "foundation", "acad": "academy", "dict": "dictionary", "arch": "archive", "gmbh": "", "ev": "", "inc": "", "ltd": "", "llc": "", "plc": ""}

#: Tokens shorter than this are corrected only if two neighbouring letters are swapped or one is doubled: too many of them are near each other.
CORRECTED = 5
#: Two misspellings with equally little support link only if both have as many letters: shorter words are near each other by chance.
LONG = 8

READING = "text string, shown string, kind string, given string, initial string, surname string, place string, body string, initials array<string>, bonus int, sure boolean, alternative string"


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def without_one(token: str) -> set[str]:
    return {token} | {token[:i] + token[i + 1 :] for i in range(len(token))}


def particle(token: str) -> bool:
    """Also if one character is wrong."""
    return token in PARTICLES or 2 <= len(token) <= 4 and any(without_one(token) & without_one(p) for p in ("von", "van", "de") if abs(len(p) - len(token)) < 2)


def single_vowels(token: str) -> str:
    """Both ways to write an umlaut become one; given names that are known stay."""
    return token if token in GIVEN else token.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def visible(text: str | None) -> str:
    """The text of an HTML fragment."""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text or "")).split())


def words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text)


def _small(word: str) -> bool:
    """A word that names of bodies may leave out, also with one slip."""
    plain = fold(word)
    if plain in SMALL or plain in BODIES or plain in SHORT_BODIES:
        return plain in SMALL
    return word.islower() and 2 <= len(plain) <= 4 and any(len(x) == 3 and abs(len(x) - len(plain)) < 2 and without_one(plain) & without_one(x) for x in SMALL)


def _body(tokens: list[str]) -> tuple[str | None, list[str]]:
    """(canonical words, initials) of a body: small words left out, abbreviations written out; an acronym has no words and initials as it is and by its capitals."""
    own = [t for t in tokens if fold(t) not in ("the", "of")]
    if len(own) == 1 and 2 <= len(own[0]) <= 5 and fold(own[0]) not in BODIES | set(SHORT_BODIES):
        capitals = "".join(c for c in own[0] if c.isupper())
        return None, sorted({own[0].lower(), capitals.lower()} - {""})
    # A single letter among words abbreviates a small word.
    kept = [fold(t) for t in own if not _small(t) and (len(t) > 1 or len(own) < 3)]
    full = [SHORT_BODIES.get(t) if t in SHORT_BODIES else next((SHORT_BODIES[x] for x in SHORT_BODIES if len(x) > 3 and t not in BODIES and len(t) < 7 and without_one(t) & without_one(x)), t) for t in kept]
    return "".join(full) or None, ["".join(t[0] for t in kept)] if kept else []


def _organisation(shown: str) -> Iterator[tuple[str, str | None, list[str], bool]]:
    """(place, words of the body, its initials, whether this is the only way) for each reading of an organisation's name."""
    brackets = re.findall(r"\(([^)]*)\)", shown)
    main = re.sub(r"\([^)]*\)", " ", shown).strip()
    for inner in brackets:
        found = words(inner)
        if len(found) == 1 and not (2 <= len(found[0]) <= 5 and found[0].upper() == found[0] and len(words(main)) > 2 or len(found[0]) <= 4):
            yield fold(found[0]), *_body(words(main)), True
            return
    tokens = words(main)
    if len(tokens) < 2:
        return
    if "," in main:
        head, _, tail = main.partition(",")
        both = [(place, body) for place, body in ((head, tail), (tail, head)) if len(words(place)) == 1 and words(body)]
        for place, body in both:
            yield fold(words(place)[0]), *_body(words(body)), len(both) == 1
        return
    yield fold(tokens[-1]), *_body(tokens[:-1]), False
    yield fold(tokens[0]), *_body(tokens[1:]), False


def readings(text: str | None) -> list[tuple]:
    """(kind, given, initial, surname, place, body, initials, bonus, sure) for each way to read a name; none if it names nobody."""
    shown = visible(text)
    if " ".join(words(fold(shown))) in NOBODY or not words(shown):
        return []
    shown = re.sub(r"^(?:%s)\b\.?\s+" % "|".join(TITLES), "", shown, flags=re.I)
    shown = re.sub(r"\((?:%s)\)|,\s*(?:%s)\s*$" % ("|".join(ROLES), "|".join(ROLES)), " ", shown, flags=re.I).strip()
    plain = [fold(t) for t in words(shown)]
    acronym = [t for t in words(shown) if 2 <= len(t) <= 5 and sum(c.isupper() for c in t) >= 2 and not particle(fold(t))]
    named = any(t in BODIES or t in SHORT_BODIES and len(plain) > 2 for t in plain)
    if named or acronym and (shown.upper() != shown or len(plain) == 2 and fold(acronym[0]) not in GIVEN and len(acronym[0]) > 1 and not re.search("[aeiouy]", fold(acronym[0]))):
        return [("organisation", None, None, None, place, body, initials, 0, sure) for place, body, initials, sure in _organisation(shown)]
    if len(plain) >= 4 and not any(t in GIVEN or len(t) == 1 for t in plain):
        return [("organisation", None, None, None, place, body, initials, 0, sure) for place, body, initials, sure in _organisation(shown)]

    # An acronym in a text of capitals only can't be told from a name yet.
    shouted = len(plain) == 2 and shown.upper() == shown and any(2 <= len(t) <= 5 and t not in GIVEN for t in plain)
    maybe = [("maybe", None, None, None, place, body, initials, 0, False) for place, body, initials, _ in _organisation(shown)] if shouted else []

    def person(given: str, rest: list[str], bonus: int, sure: bool | None = False) -> list[tuple]:
        given = single_vowels(given) if single_vowels(given) in GIVEN else given
        rest = [single_vowels(t) for t in rest]
        surname = "".join(t for t in rest if not particle(t)) or "".join(rest)
        if not surname or not given:
            return []
        if len(given) == 1:
            return [("person", None, given, surname, None, None, None, bonus, sure is not None)]
        return [("person", given, given[0], surname, None, None, None, bonus + (1000 if given in GIVEN else 0) - (1000 if surname in GIVEN else 0), bool(sure))]

    out: list[tuple] = []
    handle = re.fullmatch(r"([^\W\d_]+)[._]([^\W\d_]+)", shown.strip())
    if handle:
        first, last = fold(handle[1]), fold(handle[2])
        givens = {first} | ({first[:-1]} if first not in GIVEN and len(first) > 2 else set())
        # A particle may be written together with the surname; which it is shows when surnames are corrected.
        bare = next((last[len(p) :] for p in sorted(PARTICLES, key=len, reverse=True) if last.startswith(p) and len(last) - len(p) >= 4), None)
        return [(*x, bare) for g in givens for x in person(g, [last], 0, None)]
    if "," in shown:
        head, _, tail = shown.partition(",")
        first = [t for t in map(fold, words(tail)) if t not in TITLES]
        last = [t for t in map(fold, words(head)) if t not in TITLES and len(t) > 1]
        if first and last:
            long = [t for t in first if len(t) > 1]
            return maybe + person(long[0] if long else first[0], last + [t for t in first if t in PARTICLES], 500, True)
    tokens = [t for t in plain if t not in TITLES and t not in ROLES]
    core = [t for t in tokens if t not in PARTICLES]
    long = [t for t in core if len(t) > 1]
    if len(long) == 1 and len(core) > 1:
        return person(next(t for t in core if len(t) == 1), long, 0)
    if len(long) == 1:
        return [("single", None, None, long[0], None, None, None, 0, False)]
    if len(long) >= 2:
        out += maybe
        out += person(long[0], long[1:], 1)
        out += person(long[-1], long[:-1], 0)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string())
    names = [x.split()[0] for x in READING.split(", ")]
    for batch in batches:
        out = [(text, fold(visible(text)), *reading, *[None] * (9 - len(reading) + 1)) for text in batch.column(0).to_pylist() for reading in readings(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def _left_out(token: Column, n: int) -> Column:
    """``token`` and its forms with up to ``n`` characters left out."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    forms = F.concat(F.array(token), one(token))
    return F.array_distinct(forms if n == 1 else F.concat(forms, F.flatten(F.transform(one(token), one))))


def _slips(token: Column) -> Column:
    """``token`` and its forms with two neighbouring letters in either order, and with doubled letters single."""
    at = lambda i: F.array_join(F.array_sort(F.array(F.substring(token, i, F.lit(1)), F.substring(token, i + 1, F.lit(1)))), "")
    swapped = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.lit("<"), at(i), F.lit(">"), F.substring(token, i + 2, F.length(token))))
    single = F.concat(F.lit("="), F.regexp_replace(token, r"(.)\1", "$1"))
    return F.array_distinct(F.concat(F.array(token, single), F.when(F.length(token) > 3, swapped).otherwise(F.array().cast("array<string>"))))


def corrections(tokens: DataFrame, known: set[str] = frozenset(), left_out: int = 1, least: int = CORRECTED, ties: bool = True) -> DataFrame:
    """(group, token, hub, support): the token of the group that each token is a misspelling of, or itself.

    tokens: (group, token, support, others), distinct; support counts distinct spellings, others
    the groups (persons, bodies) a token stands with. Two tokens meet if they share a form with up
    to ``left_out`` characters left out, and the less supported one gives way only with evidence:

    * A token of ``known`` (a fixed vocabulary) stays as it is and takes others in.
    * A token that two or more others stand with is a name of its own, unless the hub has over ten
      times as many or stands with all of them too: relatives may share a misspelling, but one family
      more or less has its own given names. So Hernandez and Fernandez, Marta and Maria stay apart.
    * The hub must have at least twice the support, thrice for tokens under LONG letters and ten
      times for a token with three spellings or more, or without ``ties`` (given names).
    * With ``ties``, two tokens of at most two spellings each also link if both have LONG letters
      and begin alike: people seldom mistype the first letter.

    Hubs are followed until nothing changes. Of tokens shorter than ``least`` only slips of three letters and more are corrected.
    """
    token, hub = F.col("token"), F.col("best.token")
    is_known = token.isin(sorted(known)) if known else F.lit(False)
    tokens = tokens.select("group", "token", "support", "others", is_known.alias("known"))
    forms = F.when(F.length(token) >= least, _left_out(token, left_out)).when((F.length(token) > 2) & F.lit(least == CORRECTED), _slips(token)).otherwise(F.array(token))
    # A form is shared by few distinct tokens (they differ in one or two letters), so a window holds them.
    best = F.max(F.struct("known", "support", "others", "token")).over(Window.partitionBy("group", "form"))
    each = tokens.withColumn("form", F.explode(forms)).withColumn("best", best)
    both_long = (F.length(token) >= LONG) & (F.length(hub) >= LONG)
    need = F.when((F.col("support") > 2) | F.lit(not ties), 10).when(both_long, 2).otherwise(3)
    first = lambda c, at: F.substring(c, at, 3)
    pair = lambda c: F.array_sort(F.split(F.substring(c, 1, 2), ""))
    begin_alike = (F.substring(token, 1, 1) == F.substring(hub, 1, 1)) | (pair(token) == pair(hub)) | (first(token, 2) == first(hub, 1)) | (first(token, 1) == first(hub, 2))
    tied = F.lit(ties) & both_long & begin_alike & (F.col("support") <= 2)
    gives_way = ~F.col("known") & (hub != token) & (F.col("best.known") | (F.col("best.support") >= need * F.col("support")) | tied)
    met = each.groupBy("group", "token").agg(F.max(F.when(gives_way, F.col("best"))).alias("best"), F.max("support").alias("support"), F.max("others").alias("others"))
    # In how many groups a token has a hub; where it has none it stands alone.
    alone = F.col("others") - F.count("best").over(Window.partitionBy("token"))
    own = (F.col("others") >= 2) & (F.col("others") * 10 > F.col("best.others")) & ((alone >= 1) | F.lit(not ties))
    met = met.withColumn("own", own).select("group", "token", "support", F.when(~F.col("own"), F.col("best")).alias("best"))
    step = materialized(met.select("group", "token", F.coalesce(hub, token).alias("hub"), "support"))
    # A hub is known, or comes later by (support, others, name) than its token, so this ends; the way is halved each time.
    while True:
        again = step.where("token <> hub").select("group", F.col("token").alias("hub"), F.col("hub").alias("hub2"))
        if step.join(again, ["group", "hub"], "left_semi").isEmpty():
            return step
        step = materialized(step.join(again, ["group", "hub"], "left").select("group", "token", F.coalesce("hub2", "hub").alias("hub"), "support"))


def _supported(rows: DataFrame, group: str, token: str, primary: Column) -> DataFrame:
    """(group, token, support, others): distinct spellings per group and token, and with how many groups the token stands (of those that are ``primary``)."""
    per = rows.where(F.col(token).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("group"), F.col(token).alias("token"))
    per = per.agg(F.count_distinct("shown").alias("support"), F.max(primary.cast("int")).alias("primary"))
    return per.select("group", "token", "support", F.sum("primary").over(Window.partitionBy("token")).alias("others"))


def _ln(c: str) -> Column:
    return F.log1p(F.coalesce(F.col(c), F.lit(0)))


def _persons(read: DataFrame) -> DataFrame:
    """(text, entity) of the spellings that have a reading as a person."""
    people = read.where("kind = 'person'").select("text", "shown", "given", "initial", "surname", "bonus", "sure", "alternative")
    # A given name stands with surnames: those are its support and its other evidence.
    beside = people.where("length(given) > 1").select(F.lit("").alias("group"), F.col("given").alias("token"), "surname").distinct()
    beside = beside.groupBy("group", "token").agg(F.count(F.lit(1)).alias("support")).withColumn("others", F.col("support"))
    given = corrections(beside, GIVEN, ties=False).select(F.col("token").alias("given"), F.col("hub").alias("g_hub"))
    people = materialized(people.join(given, "given", "left"))

    # How often a token is one or the other, by spellings: those with one reading only, and all.
    roles = people.select("shown", "sure", F.explode(F.array(F.struct(F.col("g_hub").alias("token"), F.lit("g").alias("role")), F.struct(F.col("surname").alias("token"), F.lit("s").alias("role")))).alias("x")).select("shown", "sure", "x.*").where("token is not null").distinct()
    count = lambda role, sure: F.count_if((F.col("role") == role) & (F.col("sure") | F.lit(not sure)))
    used = materialized(roles.groupBy("token").agg(count("g", True).alias("sure_g"), count("s", True).alias("sure_s"), count("g", False).alias("all_g"), count("s", False).alias("all_s")))
    as_given, as_surname = (used.select(*[F.col(c).alias(f"{c}{x}") for c in used.columns]) for x in ("1", "2"))
    scored = people.join(as_given, F.col("g_hub") == F.col("token1"), "left").join(as_surname, F.col("surname") == F.col("token2"), "left")
    known = F.create_map(*[x for full in sorted(GIVEN) for x in (F.lit(full), F.lit(1))])
    corrected = F.when(F.col("g_hub").isNotNull() & (F.col("bonus") < 900) & known[F.coalesce("g_hub", F.lit(""))].isNotNull(), 900).otherwise(0)
    # Rarity: what is common as a given name and rare as a surname; readings without choice weigh most.
    rarity = 20 * (_ln("sure_g1") + _ln("sure_s2") - _ln("sure_s1") - _ln("sure_g2")) + _ln("all_g1") - _ln("all_s2")
    best = scored.groupBy("text").agg(F.max_by(F.struct("shown", "g_hub", "initial", "surname", "alternative"), F.struct((F.col("bonus") + corrected + rarity).alias("score"), F.col("surname"), F.col("g_hub"))).alias("x")).select("text", "x.*")

    # The full names a given name stands for; none for an initial. A surname is corrected among people whose given names begin alike.
    full = F.create_map(*[x for short, names_ in sorted(FULL_NAMES.items()) for x in (F.lit(short), F.array(*map(F.lit, names_)))])
    candidates = F.when(F.col("g_hub").isNotNull(), F.coalesce(full[F.col("g_hub")], F.array("g_hub")))
    letters = F.array_distinct(F.transform(F.coalesce("candidates", F.array("initial")), lambda c: F.substring(c, 1, 1)))
    best = materialized(best.withColumn("candidates", candidates).withColumn("least_ini", F.array_min(letters)).withColumn("ini", F.explode(letters)).withColumn("surname", F.explode(F.array_compact(F.array("surname", "alternative")))).drop("alternative"))
    hubs = corrections(_supported(best, "ini", "surname", F.col("ini") == F.col("least_ini"))).select(F.col("group").alias("ini"), F.col("token").alias("surname"), F.col("hub").alias("s_hub"), F.col("support").alias("s_support"))
    best = best.join(hubs, ["ini", "surname"]).groupBy("text").agg(F.max_by(F.struct("shown", "g_hub", "initial", "candidates", "s_hub"), F.struct(F.col("s_hub") != F.col("surname"), "s_support", "s_hub")).alias("x")).select("text", "x.*")
    best = materialized(best)

    # Rewritings that one person alone has: (surname, initial) and (surname, full name).
    certain = best.where("size(candidates) = 1").select("s_hub", F.col("candidates")[0].alias("full")).distinct()
    by_initial = certain.groupBy("s_hub", F.substring("full", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("full")).where("n = 1").drop("n")
    initials = best.where("candidates is null").join(by_initial, ["s_hub", "initial"], "left").select("text", "shown", "s_hub", F.coalesce("full", F.concat("initial", F.lit("."))).alias("given"))
    several = best.where("size(candidates) > 1").select("text", "shown", "s_hub", "g_hub", F.explode("candidates").alias("full")).join(certain.withColumn("found", F.lit(True)), ["s_hub", "full"], "left")
    several = several.groupBy("text").agg(F.first("shown").alias("shown"), F.first("s_hub").alias("s_hub"), F.count("found").alias("n"), F.max(F.when(F.col("found"), F.col("full"))).alias("full"), F.first("g_hub").alias("g_hub"))
    several = several.select("text", "shown", "s_hub", F.when(F.col("n") == 1, F.col("full")).otherwise(F.col("g_hub")).alias("given"))
    settled = best.where("size(candidates) = 1").select("text", "shown", "s_hub", F.col("candidates")[0].alias("given")).unionByName(initials).unionByName(several)
    settled = materialized(settled)
    # Two misspellings of one surname may differ in two places: they meet only under the same given name.
    meeting = corrections(_supported(settled, "given", "s_hub", F.lit(True)), left_out=2, least=LONG).select(F.col("group").alias("given"), F.col("token").alias("s_hub"), F.col("hub").alias("surname"))
    # Two tokens in either order are one person, whichever was read as the given name.
    return settled.join(meeting, ["given", "s_hub"]).select("text", F.concat_ws("|", F.lit("person"), F.greatest("surname", "given"), F.least("surname", "given")).alias("entity"))


def _organisations(read: DataFrame) -> DataFrame:
    """(text, entity) of the spellings that have a reading as an organisation. Capitals count only if another spelling has the same body at the same place."""
    rows = read.where("kind in ('organisation', 'maybe')").select("text", "shown", "kind", "place", "body", "initials", "sure").where("length(place) > 1 and size(initials) > 0")
    rows = rows.withColumn("ini", F.explode("initials")).where("length(ini) > 1")
    places = corrections(_supported(rows, "ini", "place", F.col("body").isNotNull())).select(F.col("group").alias("ini"), F.col("token").alias("place"), F.col("hub").alias("p_hub"))
    rows = materialized(rows.join(places, ["ini", "place"]))
    firm = rows.where("kind = 'organisation'")
    initials = firm.select("shown", "ini").distinct().groupBy("ini").agg(F.count(F.lit(1)).alias("b_support"))
    as_place = firm.where("sure").select("shown", "p_hub").distinct().groupBy("p_hub").agg(F.count(F.lit(1)).alias("p_support"))
    at_place = firm.select("p_hub", "ini").distinct()
    sure = firm.unionByName(rows.where("kind = 'maybe'").join(at_place, ["p_hub", "ini"], "left_semi"))
    scored = sure.join(initials, "ini", "left").join(as_place, "p_hub", "left")
    order = F.struct(~F.col("p_hub").isin(sorted(BODIES)), F.coalesce("p_support", F.lit(0)) > 0, F.coalesce("b_support", F.lit(0)), F.length("ini"), F.col("p_hub"))
    chosen = materialized(scored.groupBy("text").agg(F.max_by(F.struct("shown", "p_hub", "body", "ini"), order).alias("x")).select("text", "x.*"))
    # Bodies of one place are told apart by their words; what stands at one place is corrected there.
    worded = corrections(_supported(chosen.where("body is not null"), "p_hub", "body", F.lit(True)).withColumn("others", F.lit(1)), left_out=2).select(F.col("group").alias("p_hub"), F.col("token").alias("body"), F.col("hub").alias("b_hub"))
    named = materialized(chosen.where("body is not null").join(worded, ["p_hub", "body"]).select("text", "p_hub", "ini", "b_hub"))
    # An acronym stands for the one body of its place with these initials, or with one of its letters more; several share none.
    unique = lambda rows: rows.distinct().groupBy("p_hub", "ini").agg(F.count(F.lit(1)).alias("n"), F.min("b_hub").alias("b_hub")).where("n = 1").drop("n")
    owners = unique(named.select("p_hub", "ini", "b_hub"))
    short = chosen.where("body is null").select("text", "p_hub", F.col("ini").alias("own"), F.explode(F.when(F.length("ini") > 3, _left_out(F.col("ini"), 1)).otherwise(F.array("ini"))).alias("ini"))
    short = short.join(owners, ["p_hub", "ini"], "left").groupBy("text").agg(F.first("p_hub").alias("p_hub"), F.first("own").alias("own"), F.max_by("b_hub", F.length("ini")).alias("exact"), F.count_distinct("b_hub").alias("n"), F.min("b_hub").alias("any"))
    short = short.select("text", "p_hub", F.coalesce("exact", F.when(F.col("n") == 1, F.col("any")), F.col("own")).alias("b_hub"))
    return named.select("text", "p_hub", "b_hub").unionByName(short).select("text", F.concat_ws("|", F.lit("organisation"), "p_hub", "b_hub").alias("entity"))


def entities(names: DataFrame, column: str = "text") -> DataFrame:
    """(text, entity): the entity each distinct spelling names.

    Null, empty and anonymous names have no entity; a spelling that can't be read as a person or
    organisation is its own. Repeated rows count once. The text alone decides, links don't.
    """
    context = names.sparkSession.sparkContext
    cores = max(context.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A fixed number of parts: reading is heavy per row, few bytes must not end up in one task.
    texts = names.select(F.col(column).alias("text")).where("text is not null").repartition(cores, "text").distinct()
    read = materialized(texts.mapInArrow(_read, READING))
    organisations = materialized(_organisations(read))
    singles = read.where("kind = 'single'").select("text", F.concat_ws("|", F.lit("single"), "surname").alias("entity"))
    return _persons(read).join(organisations, "text", "left_anti").unionByName(organisations).unionByName(singles)


def links(authors: DataFrame, recordings: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): pairs of authors, and recordings without author with their authors.

    authors: author_ordinal, author_text; recordings: recording_id, artist, author_ordinal.
    Repeated rows give no repeated pairs.
    """
    written = authors.select("author_ordinal", F.col("author_text").alias("text")).where("author_ordinal is not null and text is not null").distinct()
    artists = recordings.select("recording_id", "author_ordinal", F.col("artist").alias("text")).where("text is not null").distinct()
    entity = materialized(entities(written.select("text").union(artists.select("text"))))
    by_author = materialized(written.join(entity, "text").select("author_ordinal", "entity").distinct())
    a, b = by_author.select("entity", F.col("author_ordinal").alias("id_a")), by_author.select("entity", F.col("author_ordinal").alias("id_b"))
    pairs = a.join(b, "entity").where("id_a < id_b").select(F.lit("author").alias("kind"), "id_a", "id_b")
    open_ones = artists.where("author_ordinal is null and recording_id is not null").join(entity, "text").select("entity", F.col("recording_id").alias("id_a"))
    found = open_ones.join(b, "entity").select(F.lit("recording").alias("kind"), "id_a", "id_b")
    return pairs.unionByName(found).distinct()
