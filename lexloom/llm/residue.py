"""Template residue, filler text, error pages and script notices (problem 9).

1. Texts are cut into units (sentences, not inside quotation marks, and lines). Units with a
   value that may be residue (a variable name, a default, a blank, filler, a message) give their
   literal skeleton: the runs of tokens around such values.
2. One pass over all texts aligns all units with these skeletons: it counts where the same
   literals stand, three at a time (two where a run is that short). What stands between them in
   the other units are the values of the same slot.
3. A slot that ordinary words fill elsewhere was left unfilled where it holds a name, a default or
   a blank. A slot that nearly always holds such a value talks about it (``the note on ...
   discusses why ... is never declined``) and mentions it. A slot is judged by the median share of
   its literals. Values that are ordinary words or signs as well (None, null, %s, [NAME]) count
   only in a slot that alignment induced; template syntax that nothing else uses counts also where
   nothing could be aligned, unless it is quoted.
4. Whole-page templates are induced by repetition. A text that many documents repeat word for
   word and that speaks of pages, servers, links and the like outside quotation marks is an error
   page, whatever its wording. A sentence or line (digits masked) that comes with error messages
   or filler in nearly all of its many documents belongs to their template, and a document that
   has it counts as one of them when other lines are judged, until no further line is found.

The pass that aligns reads every token of every text: tokens become numbers, three numbers a hash,
and a fixed table of bits passes over all that no skeleton has, so that its shuffle has little to
carry at any size. All statistics are exact and over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.tables import materialized, spread

#: A slot mentions residue if this share of its template's units have some.
MENTION = 0.5
#: Fewer units than this tell nothing about a triple.
SEEN = 4
#: A line belongs to error pages if it comes with error messages in this share of at least so many documents.
PAGE_SHARE, PAGE_DOCUMENTS = 0.9, 5
#: A text with so many different words of user interfaces, repeated in PAGE_DOCUMENTS documents, is an error page.
INTERFACE_WORDS = 2
#: Hash buckets of the triples worth counting; a table of so many bits goes to each task, whatever the data.
BUCKETS = 1 << 22

#: A variable's name as templates write it, attributes included; one letter is enough.
_NAME = r"[A-Za-z_][\w.\- ]*(?:![rsa]|:[\w.]{1,10})?"
#: Defaults and filters after it, of any length.
_FILTERS = r"(?:\|[^{}]*)?"

#: Delimiters of unfilled placeholders.
PLACEHOLDERS = [
    r"\{\{\{\s*(?=[\w])(?>[^{}|]*)%(f)s\}\}\}",
    r"\{\{[#/^>!&]\s*%(n)s[^{}]*\}\}",
    r"<<\s*%(n)s\s*>>",
    r"\{\{\s*(?:\d+|%(n)s)\s*%(f)s\}\}",
    r"\{%%[^%%{}]+%%\}",
    r"<%%=?[^%%<>]+%%>",
    r"&lt;\s*%(n)s\s*&gt;",
    r"\[\[%%\s*%(n)s\s*%%\]\]",
    r"[$#]\{\s*%(n)s\s*%(f)s\}",
    r"%%\(%(n)s\)[sdr]",
    r"%%[A-Z][A-Z_0-9]*%%",
    r"@@\w+@@",
    r"(?<![A-Za-z0-9_])__[A-Za-z][A-Za-z_0-9]*?__(?![A-Za-z0-9_])",
    r"\$[A-Z][A-Z_0-9]*\$",
    r"\{\d+(?:\.\w+)?(?:![rsa])?\}",
    r"\{[A-Za-z_]\w*\}",
    r"<(?!/|noscript|br\b|p\b|b\b|i\b|em\b|li\b|ul\b|ol\b|div\b|span\b|a\b|q>|s>|u>|h[1-6]>)(?:[a-z][a-z_0-9]+(?: [a-z0-9]+){0,2}|[a-z])>",
    r"\[(?:insert|your|add|enter|put) [^\[\]]+\]",
    r"\[[A-Z][A-Z_0-9 ]* HERE\]",
    r"\b(?:TBD|FIXME|TODO)\s*\([^()]+\)",
    r"\bTODO: ?\w+",
    r"\bFIXME \w+",
    r"\bXXX[-_]\w+",
    r"\b(?:TBD|FIXME|TODO|XXX)\b",
    r"\[object Object\]",
    r"_{4,}",
]

#: Signs of variables that have other uses too, any word with a delimiter, and blanks between quotation marks or brackets.
SIGNS = [r"\[[A-Z][A-Z_0-9]{2,}\]", r"(?<!\w)%%[sd](?!\w)", r"(?<![\w{}<>$@#~|^\\])(?!</?(?:[a-z]|br|em|li|ul|ol|div|span|noscript|h[1-6])\b)[{}<>$@#~|^\\]+[A-Za-z][\w.:-]*[{}<>$@#~|^\\]+(?!\w)"]
#: Defaults and blanks that stand where a value is missing.
DEFAULTS = [r"(?<![\w])(?:undefined|null|NaN|None|nil|N/A)(?![A-Za-z_])", r"“\s*”|„\s*“|«\s*»|「\s*」|\(\s*\)|（\s*）|\[\s*\]"]

#: Filler text.
_LOREM = "lorem|ipsum|dolor|sit|amet|sed|nec|velit|urna|porta|tempor|magna|orci|nulla|vero|aliqua|massa|consectetur|adipiscing|elit"
_LATER = r"(?: ?\((?:pendiente|folgt|à compléter|à venir|pending|draft)\)| plus tard| ici| aquí| más tarde| später| hier| here| later| before publishing|\.\.\.|…)"
FILLERS = [
    r"\blorem ipsum(?:\W+(?:%(l)s))*",
    r"\b(?:%(l)s)(?:\W+(?:%(l)s)){4,}\b",
    r"\b(?:asdf|qwerty|blah)(?:\W+(?:asdf|qwerty|blah|test|\d+))+\b",
    r"\bfoo\W+bar(?:\W+ba[rz])*\b",
    r"\btest\W+test(?:\W+(?:test|\d+))*\b",
    r"(?:テスト[ 　]*){2,}",
    r"あああ+[ 　]*い*",
    r"ダミーテキスト(?:です)?",
    r"（仮）[^。「」\n]{0,15}(?:を(?:書く|入力(?:する|して(?:ください)?)?|追加(?:する)?))?",
    r"[^。「」\s]{1,8}を(?:入力|記入|追加)してください",
    r"ここに[^。」\n]{1,20}(?:書く|書いて(?:ください)?|入ります|入力(?:して(?:ください)?)?|を入れ(?:る|てください))",
    r"本文が入ります",
    r"\b(?:Mustertext|Blindtext)\b(?: für den Satzspiegel)?",
    r"\bHier steht später der Text",
    r"\b(?:Noch einfügen|Bitte ersetzen): ?[^\W\d_]+(?: eintragen)?%(later)s?",
    r"\bHier (?:die|der|das) [^\W\d_]+%(later)s",
    r"\bfaux texte\b(?: pour la mise en page)?",
    r"(?:\b(?:ceci est )?un )?\btexte? (?:de démonstration|à remplacer)",
    r"\b(?:Ajouter|Insérer|Remplacer) (?:la|le|l[’']|cette|ce|cet) ?[^\W\d_]+%(later)s?",
    r"\bsaisissez ici (?:la|le|l[’']) ?[^\W\d_]+",
    r"\b(?:texto de relleno|texto de prueba|contenido de prueba)\b(?:, sustituir| \(pendiente\))?",
    r"\b(?:Aquí va|Escriba aquí|Insertar|Falta) (?:la|el) [^\W\d_]+%(later)s?",
    r"\bSustituir est[ae] [^\W\d_]+%(later)s?",
    r"\bsample text\b(?:, to be replaced(?: before release)?)?",
    r"(?:\bthis is )?\b(?:dummy|placeholder) (?:text|copy|entry)\b(?: for layout only)?",
    r"\btext goes here\b",
    r"\byour (?:definition|text|gloss|example)[^.!?”\n]{0,20} here\b",
    r"\b(?:insert|add|replace) (?:the|your|this) [^\W\d_]+(?: [^\W\d_]+)? ?(?:here|later|before publishing|\.\.\.|…)",
    r"(?:\[draft\] ?)?\bmissing [^\W\d_]+(?: [^\W\d_]+)? ?(?:here|later|before publishing|\.\.\.|…)",
    r"\[draft\]",
    r"\b(?:Bitte|Hier) (?:die |den |das )?[^\W\d_]+ eintragen",
    r"(?:^|(?<=[“«„「\"]))(?:insert|add|replace) (?:(?:your|this) [^\W\d_]+(?: [^\W\d_]+)?|the (?:gloss|definition|etymology|pronunciation|usage note|example|example sentence|text|translation|meaning|note|title|description))(?=\W*(?:$|[”»“」\"]))",
    r"\bwrite (?:a|an|the|your) [^.!?\n]+? in this (?:box|field)\b",
    r"\btesto segnaposto\b|\btexto de marcador\b|\btekst zastępczy\b",
    r"^\W*(?:this (?:page|entry|section) (?:is )?)?(?:coming soon|under construction)\W*$",
    r"\bdo not publish\b",
]

_SUBJECT = r"[^\W_][\w'’,-]*(?:[ 　][^\W_][\w'’,-]*){0,6}"
#: How error messages and script notices end or read as a whole, by language.
ERRORS = [
    # en
    r"%(s)s (?:was|were) moved or deleted", r"%(s)s could not be (?:loaded|found)(?: on this server)?", r"%(s)s (?:cannot|can't) be (?:reached|loaded|found|shown|displayed)", r"%(s)s (?:is|are) not available right now",
    r"%(s)s took too long to respond", r"%(s)s returned an unexpected response", r"%(s)s did not answer in time", r"%(s)s is down for maintenance", r"service (?:temporarily )?unavailable", r"(?:page )?not found", r"internal server error",
    r"error establishing a database connection", r"too many requests(?: from your address)?", r"access denied", r"your session has expired", r"you (?:don't|do not) have permission to access .{1,40}", r"something went wrong", r"bad gateway|gateway timeout|forbidden",
    r"traceback \(most recent call last\).*",
    # it, pt, nl, ko, zh
    r"pagina non trovata|errore interno del server|accesso negato|servizio non disponibile", r"página não encontrada|erro interno do servidor|acesso negado", r"pagina niet gevonden|toegang geweigerd", r"[^.\n]*찾을 수 없습니다|접근이 거부되었습니다|서버 오류가 발생했습니다", r"[^。\n]*(?:页面不存在|找不到页面|未找到页面|頁面不存在|找不到網頁|服务器内部错误)",
    # fr
    r"%(s)s n[’']a pas pu être chargée?", r"%(s)s est inaccessible", r"%(s)s n[’']existe plus", r"%(s)s ne répond pas", r"erreur interne du serveur", r"votre session a expiré", r"page introuvable", r"accès refusé", r"service momentanément indisponible",
    # de
    r"%(s)s konnten? nicht geladen werden", r"%(s)s existiert nicht mehr", r"%(s)s antwortet nicht", r"%(s)s ist gerade nicht erreichbar", r"seite nicht gefunden", r"diese seite benötigt skripte.{0,20}", r"in ihrem browser ist javascript abgeschaltet", r"interner serverfehler", r"zugriff verweigert", r"(?:ihre|deine) sitzung ist abgelaufen", r"der dienst ist vorübergehend nicht verfügbar",
    # es
    r"%(s)s no se pudo cargar", r"%(s)s ya no existe", r"%(s)s no responde", r"%(s)s no está (?:accesible|disponible por ahora|disponible)", r"página no encontrada", r"error interno del servidor", r"acceso denegado", r"su sesión ha caducado", r"esta página necesita scripts.{0,20}",
    # ja
    r"[^。\n]{1,20}を読み込めませんでした", r"[^。\n]{0,20}(?:ページ|項目|録音|見出し語|ファイル|サーバー)[^。\n]{0,12}(?:見つかりません(?:でした)?|から応答がありません|は現在ご利用いただけません|は削除されました|は移動または削除されました|は削除されたか移動しました|は存在しません|に接続できません(?:でした)?|にアクセスできません)",
    r"[^。\n]{0,10}エラーが発生しました", r"アクセスが拒否されました", r"セッションの有効期限が切れました", r"[^。\n]{0,20}メンテナンス中です", r"ただいま混み合っています", r"(?:しばらくしてから|\d+分後に)お試しください",
]
#: Notices that scripts are required: words in this order in one sentence, the first of the first kind decides.
SCRIPTS = [
    (r"\b(?:enable|requires?|turn on|switch on|allow|unblock|run|support|disabled?|activate)\b", r"\b(?:javascript|scripts?|scripting)\b"),
    (r"\b(?:javascript|scripts?|scripting) (?:is|are|must be) (?:disabled|required|on|off|needed|blocked)\b",),
    (r"\bchecking your browser before loading the page",),
    (r"\b(?:activez|autorisez|débloquez|activer|autoriser)\b", r"\b(?:javascript|scripts?)\b"),
    (r"\bbesoin de scripts\b",),
    (r"\b(?:javascript|scripts?) (?:est|sont) (?:désactivée?s?|requis|nécessaires?)\b",),
    (r"\b(?:aktivieren|einschalten|erlauben|zulassen)\b", r"\b(?:javascript|skripte?)\b"),
    (r"\b(?:javascript|skripte?)\b", r"\b(?:aktivieren|einschalten|erlaubt|erlauben|zulassen|deaktiviert|erforderlich|benötigt|freigeben)\b"),
    (r"\b(?:habilite|active|desbloquee|permita|activar|habilitar)\b", r"\b(?:javascript|scripts?)\b"),
    (r"\b(?:javascript|scripts?) (?:desactivados?|necesarios?|bloqueados?)\b",),
    (r"(?:javascript|スクリプト)", r"(?:有効|無効|オン|必要|許可|外して|実行)"),
]
#: Within a sentence; each kind of word is looked for once, so that the longest unit takes one pass.
_NOTICES = ["".join(rf"(?>[^.!?。！？\n]*?{w})" for w in kinds) + r"[^.!?。！？\n]*" for kinds in SCRIPTS]

_STATUS = r"(?:\*{3}\s*)?(?:(?:HTTP|Status|Error|Fehler|Erreur|ERROR)[ :]*)?\b[1-5]\d\d\b"
_TAIL = r"(?:[;,] ?(?:try again later|inténtelo más tarde|réessayez(?: plus tard| dans \d+ minutes)?|bitte später erneut versuchen))?\s*(?:[(（](?:(?:code|ref\.?|réf\.?|request|kennung|código|コード)[ :#.]*[0-9a-f]+|#?[0-9a-f]+)\.?[)）])?"

_SPAN = re.compile("|".join(f"(?:{p})" for p in [x % {"n": _NAME, "f": _FILTERS} for x in PLACEHOLDERS]))
_SIGN = re.compile("|".join(f"(?:{p % {}})" for p in SIGNS))
_DEFAULT = re.compile("|".join(f"(?:{p})" for p in DEFAULTS))
_FILLER = re.compile("|".join(f"(?:{p.replace('%(l)s', _LOREM).replace('%(later)s', _LATER)})" for p in FILLERS), re.I)
_MESSAGE = re.compile("|".join(f"(?:{p % {'s': _SUBJECT}})" if "%(s)s" in p else f"(?:{p})" for p in ERRORS + _NOTICES), re.I)
_PAGE_UNIT = re.compile(rf"^\W*(?:{_STATUS}\s*[-–:：.]?\s*)?(?:oops!?\s*)?(?:{_MESSAGE.pattern}){_TAIL}\W*$", re.I)
_STATUS_UNIT = re.compile(r"^\W*(?:\*{3}\s*)?(?:(?:HTTP|Status|Error|Fehler|Erreur)[ :]+)[1-5]\d\d\b\W*$|^\W*</?noscript>\W*$", re.I)
_STATUS_LINE = re.compile(r"^\W*(?:\*{3}\s*)?(?:HTTP|Status|Error)[ :]+[1-5]\d\d\b\s*[-–:]?\s*\S.{2,80}$", re.I)
#: Words of status lines and tags.
_STATUS_WORDS = ("http", "status", "error", "fehler", "erreur", "<")
#: What every placeholder, sign, default and blank has somewhere.
_SPAN_WORDS = (*"{}<>&$#@[~|^\\", "%s", "%d", "%(", "__", "TBD", "TODO", "FIXME", "XXX", "undefined", "null", "NaN", "None", "nil", "N/A", "“”", "“ ”", "„“", "„ “", "«»", "« »", "「」", "「 」", "()", "( )", "（）", "（ ）")
_PERCENT = re.compile(r"%[A-Z]")
#: Two words of dummy Latin in a row.
_LATIN = tuple(_LOREM.split("|"))
_LOREM_PAIR = re.compile(rf"\b(?:{_LOREM})\W+(?:{_LOREM})\b")
#: What every filler has somewhere, in lower case; most texts are passed over without trying a pattern.
_FILLER_WORDS = (
    *("lorem ipsum dolor amet velit urna porta tempor magna orci nulla vero aliqua massa consectetur adipiscing elit".split()),
    *("asdf qwerty blah テスト あああ ダミー （仮） ここに 本文 してください を書く mustertext blindtext eintragen einfügen ersetzen folgt später hier démonstration texte ajouter insérer remplacer saisissez".split()),
    *("relleno prueba aquí insertar falta sustituir dummy placeholder insert replace publish draft missing".split()),
    *("test test", "foo", "segnaposto", "marcador", "zastępczy", "coming soon", "under construction", "sample text", "text goes here", "your ", "add the", "add your", "add this", "in this "),
)
#: The same for messages and notices.
_MESSAGE_WORDS = (
    *("deleted could cannot can't available respond unexpected answer maintenance found server database requests denied expire permission wrong gateway forbidden traceback".split()),
    *("pas inaccessible répond erreur introuvable refusé indisponible expiré interno nicht geladen existiert antwortet fehler verweigert abgelaufen verfügbar sitzung".split()),
    *("cargar responde está encontrada denegado caducado existe 読み込め 見つかり 応答 利用いただけ 削除 存在 接続 アクセス エラー セッション メンテナンス 混み合 お試し script スクリプト skript checking trovata errore accesso disponibile encontrada erro acesso niet geweigerd 찾을 거부 오류 页面 頁面 网页 網頁 错误".split()),
)


class Hints:
    """Which of the listed words a text has: what no unit of it can be is never tried, and nothing else is passed over."""

    def __init__(self, text: str, low: str, among: Hints | None = None) -> None:
        self.span = [w for w in (among.span if among else _SPAN_WORDS) if w in text]
        if not among and "%" in text and _PERCENT.search(text):
            self.span.append("%")
        self.filler = [w for w in (among.filler if among else _FILLER_WORDS) if w in low]
        self.latin = [w for w in (among.latin if among else _LATIN) if w in low]
        self.message = [w for w in (among.message if among else _MESSAGE_WORDS) if w in low]
        self.status = [w for w in (among.status if among else _STATUS_WORDS) if w in low]
        if self.latin and (sum(map(low.count, self.latin)) < 5 or not _LOREM_PAIR.search(low)):
            self.latin = []

    def __bool__(self) -> bool:
        return bool(self.span or self.filler or self.latin or self.message or self.status)


_QUOTED = re.compile(r"“[^“”\n]*”|„[^„“”\n]*[“”]|«[^«»\n]*»|「[^「」\n]*」|『[^『』\n]*』|\"[^\"\n]*\"")
_HELD = re.compile(_QUOTED.pattern + r"|\([^()\n]*\)|（[^（）\n]*）|(?<![{<\[])(?>[{<\[]+)[^{}<>\[\]\n]+[}>\]]+")
_CUT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
#: Kana and Han one by one, words, signs.
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+|[^\w\s]")
_DIGITS = re.compile(r"\d+")
_TAGS = re.compile(r"</?noscript>", re.I)
_MARKS = re.compile(r"^\s*(?:[-*•]|\d+\.|\*{3})\s+")


def units(text: str) -> list[str]:
    """Sentences and lines of a text, white space made plain; a sentence doesn't end inside quotation marks or brackets."""
    out = []
    for line in text.split("\n"):
        line = _MARKS.sub("", " ".join(line.split()))
        if not line:
            continue
        held = [m.span() for m in _HELD.finditer(line)]
        start = 0
        for m in _CUT.finditer(line):
            if any(a < m.start() < b for a, b in held):
                continue
            if line[start : m.start()].strip():
                out.append(line[start : m.start()].strip())
            start = m.end()
        if line[start:].strip():
            out.append(line[start:].strip())
    return out


def tokens(text: str) -> list[str]:
    """In lower case; numbers are one token, 0."""
    return _TOKEN.findall(_DIGITS.sub("0", text.lower()))


def is_message(text: str) -> bool:
    return bool(_PAGE_UNIT.match(text))


def literals(unit: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The tokens outside the spans, in runs."""
    runs, at = [], 0
    for a, b in [*spans, (len(unit), len(unit))]:
        if run := tokens(unit[at:a]):
            runs.append(run)
        at = max(at, b)
    return runs


def triples(runs: list[list[str]]) -> set[str]:
    """Three neighbouring tokens each; a run of two is one piece."""
    return {" ".join(run[i : i + 3]) for run in runs for i in range(max(len(run) - 2, len(run) == 2))}


def pieces(runs: list[list[str]]) -> list[str]:
    """All that may be a piece of another unit's runs."""
    return [" ".join(run[i : i + n]) for run in runs for n in (2, 3) for i in range(len(run) - n + 1)]


def examine(unit: str, hints: Hints | None = None) -> tuple[str, list[tuple[int, int]]]:
    """(kind, spans) of a unit.

    page: an error message or notice as a whole; whole: nothing but residue; slot: residue beside
    words; weak: only values that are residue in an induced slot; plain: none.
    """
    hints = Hints(unit, unit.lower(), hints)
    if not hints:
        return "plain", []
    bare = _TAGS.sub(" ", unit).strip() if "<" in unit else unit
    if not bare:
        return ("page", [(0, len(unit))]) if unit else ("plain", [])
    quoted = [m.span() for m in _QUOTED.finditer(unit)] if hints.message else []
    if hints.message and (not quoted and is_message(bare) or bare != unit) or hints.status and (_STATUS_UNIT.match(bare) or _STATUS_LINE.match(bare)):
        return "page", [(0, len(unit))]
    strong = [m.span() for m in _SPAN.finditer(unit)] if hints.span else []
    strong += [m.span() for m in _FILLER.finditer(unit)] if hints.filler or hints.latin else []
    for a, b in quoted:
        inner = unit[a + 1 : b - 1].strip()
        if is_message(inner) or any(is_message(x) for x in _CUT.split(inner) if x.strip()):
            strong.append((a + 1, b - 1))
    signs = [m.span() for m in _SIGN.finditer(unit)] if hints.span else []
    weak = signs + [m.span() for m in _DEFAULT.finditer(unit)] if hints.span else []
    if not strong and not weak:
        return "plain", []
    merged: list[tuple[int, int]] = []
    for a, b in sorted(strong + weak):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    if not strong and sum(unit[a] in "[%" for a, _ in signs) < 2:
        return "weak", merged
    rest = any(t[0].isalpha() for run in literals(unit, merged) for t in run)
    return ("slot" if rest else "whole"), merged


class _Numbers(dict):
    """A number for each token, computed once."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 1_000_000:  # memory only: numbers depend on the token alone
            self.clear()
        found = self[token] = xxhash.xxh64_intdigest(token)
        return found


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def buckets(numbers: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each ``n`` neighbouring tokens."""
    if len(numbers) < n:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = sum((numbers[i : len(numbers) - n + 1 + i] * _FACTORS[i] for i in range(n)), np.uint64(n))
        return ((mixed ^ (mixed >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket(piece: str) -> int:
    own = piece.split(" ")
    return int(buckets(np.array([_Numbers()[t] for t in own], dtype=np.uint64), len(own))[0])


#: Words of user interfaces, in lower case; of wide scripts as parts of text.
INTERFACE = frozenset(
    "page link home homepage server site website browser reload refresh retry oops sorry cookies javascript login url http administrator webmaster redirect unavailable session request error gateway timeout gone try "
    "seite startseite browser neu laden fehler anmelden serveur navigateur actualiser erreur accueil lien página enlace servidor navegador recargar error inicio sitio pagina errore riprova".split()
)
INTERFACE_WIDE = ("ページ", "サーバー", "エラー", "ブラウザ", "再読み込み", "アクセス", "サイト", "リンク", "ログイン", "페이지", "서버", "오류", "홈", "页面", "服务器", "首页")


def of_interface(text: str, low: str) -> bool:
    """Whether a text has INTERFACE_WORDS of them outside quotation marks."""
    if sum(w in low for w in INTERFACE) + sum(w in text for w in INTERFACE_WIDE) < INTERFACE_WORDS:
        return False
    bare = _QUOTED.sub(" ", text)
    return len(INTERFACE.intersection(tokens(bare))) + sum(w in bare for w in INTERFACE_WIDE) >= INTERFACE_WORDS


def digest(line: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(line)


_DIGIT = re.compile(r"\d")
_HEX = re.compile(r"(?<![0-9a-z])(?=[a-f]*\d)[0-9a-f]{6,}|\d+")


def masked(unit: str) -> str:
    """Case and numbers, hexadecimal ones too, don't count."""
    low = unit.casefold().strip()
    return _HEX.sub("0", low) if _DIGIT.search(low) else low


SUSPECT = "doc_id long, unit int, kind string, triples array<string>, pieces array<string>, quoted boolean, lines array<binary>, page binary"


def lines_of(text: str) -> set[bytes]:
    """The sentences and lines of a text by their digests, with case and numbers masked."""
    return {digest(masked(x)) for line in text.split("\n") for x in _CUT.split(_MARKS.sub("", line)) if x.strip()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per unit that may be residue: its kind, its literals and whether all of it is quoted.

    One row of kind lines for each text with an error message or filler, or that may be a page of
    an interface: its lines, and of the latter its digest.
    """
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.binary()), pa.binary())
    for batch in batches:
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain = " ".join(text.split())
            low = plain.lower()
            hints, evident = Hints(plain, low), False
            for i, unit in enumerate(units(text)) if hints else ():
                kind, spans = examine(unit, hints)
                if kind == "plain":
                    continue
                evident |= kind in ("page", "whole")
                runs = literals(unit, spans) if kind in ("slot", "weak") else []
                held = [m.span() for m in _QUOTED.finditer(unit)]
                out.append((doc, i, kind, sorted(triples(runs)), pieces(runs), any(a <= x and y <= b for a, b in held for x, y in spans), None, None))
            page = digest(plain.casefold()) if of_interface(plain, low) else None
            if evident or page:
                out.append((doc, -1, "lines", None, None, None, sorted(lines_of(text)), page))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [x.split()[0] for x in SUSPECT.split(", ")])


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"))


def suspects(documents: DataFrame) -> DataFrame:
    return _texts(documents).mapInArrow(_scan, SUSPECT)


def line_bucket(line: bytes) -> int:
    return int.from_bytes(line[:4], "big") % BUCKETS


def _table(rows: DataFrame, number) -> object:
    """A broadcast table of BUCKETS bits: those of the numbers of the rows' first column. Its size doesn't depend on the data."""
    marks = rows.mapInPandas(lambda it: (pd.DataFrame({"b": sorted({number(x) for x in pdf.iloc[:, 0]})}, dtype="int64") for pdf in it), "b long")
    found = np.zeros(BUCKETS, dtype=bool)
    found[[r.b for r in marks.distinct().toLocalIterator()]] = True  # at most BUCKETS numbers
    return rows.sparkSession.sparkContext.broadcast(np.packbits(found).tobytes())


def _bits(table: object) -> np.ndarray:
    return np.unpackbits(np.frombuffer(table.value, dtype=np.uint8)).astype(bool)


def _counted(documents: DataFrame, wanted: DataFrame | None, lines: DataFrame) -> DataFrame:
    """(key, n): how often each wanted piece stands in a text; (line, doc_id): where each wanted sentence or line stands."""
    flags, held_lines = None if wanted is None else _table(wanted, bucket), _table(lines, line_bucket)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, line_bits = None if flags is None else _bits(flags), _bits(held_lines)
        numbers = _Numbers()
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())

        def align(read: list[str], seen: Counter) -> None:
            array = np.fromiter(map(numbers.__getitem__, read), dtype=np.uint64, count=len(read))
            for n in (2, 3):
                seen.update(" ".join(read[i : i + n]) for i in np.flatnonzero(bits[buckets(array, n)]).tolist())

        for batch in batches:
            seen: Counter = Counter()
            held: list[tuple] = []
            read: list[str] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += [(None, line, doc, None) for line in lines_of(text) if line_bits[line_bucket(line)]]
                if flags is None:
                    continue
                read += tokens(text)
                read.append("")  # nothing stands across two texts: no piece has an empty token
                if len(read) > 200_000:
                    align(read, seen)
                    read = []
            if flags is not None:
                align(read, seen)
            held += [(key, None, None, n) for key, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], ["key", "line", "doc_id", "n"])

    return _texts(documents).mapInArrow(rows, "key string, line binary, doc_id long, n long")


def suspicious(text: str) -> Hints:
    """What any unit of the text may be other than plain; false if nothing."""
    plain = " ".join(text.split())
    return Hints(plain, plain.lower())


def _with_template(documents: DataFrame, held: DataFrame, paged: DataFrame) -> DataFrame:
    """(doc_id) of the documents that have a line of an error template.

    held: (line, doc_id), where every line of ``paged`` stands; paged: (doc_id) of the documents
    with an error message. What is found is evidence for further lines: those of newly found
    documents are counted in all documents by one more pass, until none is found.
    """
    flagged = paged
    while True:
        sizes = held.groupBy("line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= PAGE_DOCUMENTS)
        errors = held.join(flagged, "doc_id", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("with_errors"))
        lines = sizes.join(errors, "line").where(F.col("with_errors") >= PAGE_SHARE * F.col("documents")).select("line")
        found = materialized(held.join(lines, "line", "left_semi").select("doc_id").distinct())
        new = materialized(found.join(flagged, "doc_id", "left_anti"))
        if new.isEmpty():
            return found
        flagged = materialized(flagged.union(new))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([x for text in batch.column(0).to_pylist() for x in lines_of(text)], pa.binary())], ["line"])

        theirs = documents.join(new, "doc_id", "left_semi").select("text").where("text is not null").mapInArrow(rows, "line binary").distinct()
        further = materialized(theirs.join(held.select("line").distinct(), "line", "left_anti"))
        if not further.isEmpty():
            more = _counted(documents, None, further).select("line", "doc_id").distinct()
            held = materialized(held.union(more.join(further, "line", "left_semi")))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, unit, reason) of every unit that is residue: page, whole, slot or weak, and of documents with a line of an error template (unit -1, template) or that are a repeated page (unit -1, repeated).

    documents: doc_id, text. Null texts and ids give no rows, empty texts have no units; texts
    are read whole. Repeated texts are judged alike, each under its id.
    """
    found = materialized(suspects(documents))
    slots = found.where("kind in ('slot', 'weak')").select("doc_id", "unit", "kind", "quoted", F.explode_outer("triples").alias("triple"))
    judging = slots.select("triple").where("triple is not null").distinct()
    held = found.where("kind in ('slot', 'weak')").select(F.explode("pieces").alias("triple")).groupBy("triple").agg(F.count(F.lit(1)).alias("residue"))
    with_residue = materialized(held.join(judging, "triple", "left_semi"))
    # Whole pages: what many documents repeat word for word.
    pages = found.where("page is not null").select("page", "doc_id").distinct()
    often = pages.groupBy("page").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= PAGE_DOCUMENTS)
    repeated = materialized(pages.join(often, "page", "left_semi").select("doc_id").distinct())
    paged = materialized(found.where(F.col("kind").isin("page", "whole")).select("doc_id").union(repeated).distinct())
    lines = materialized(found.where("kind = 'lines'").join(paged, "doc_id", "left_semi").select(F.explode("lines").alias("line")).distinct())
    counted = materialized(_counted(documents, with_residue, lines))
    total = counted.where("key is not null").groupBy(F.col("key").alias("triple")).agg(F.sum("n").alias("n"))
    share = with_residue.join(total, "triple").where(F.col("n") >= SEEN).select("triple", (F.col("residue") / F.col("n")).alias("share"))
    per_unit = slots.join(share, "triple", "left").groupBy("doc_id", "unit", "kind").agg(F.percentile("share", 0.5).alias("median"), F.first("quoted").alias("quoted"))
    # Without any template to align with, quotation marks decide for what can be nothing else, and other values are words.
    alone = (F.col("kind") == "slot") & ~F.col("quoted")
    left_over = per_unit.where(F.coalesce(F.col("median") < MENTION, alone)).select("doc_id", "unit", F.col("kind").alias("reason"))
    whole = found.where(F.col("kind").isin("page", "whole")).select("doc_id", "unit", F.col("kind").alias("reason"))
    # Lines that come with error messages nearly wherever they stand: the rest of the error pages' template.
    held = materialized(counted.where("line is not null").select("line", "doc_id").distinct().join(lines, "line", "left_semi"))
    template = _with_template(documents.select("doc_id", "text"), held, paged)
    of_document = lambda rows, reason: rows.select("doc_id", F.lit(-1).alias("unit"), F.lit(reason).alias("reason"))
    return left_over.unionByName(whole).unionByName(of_document(template, "template")).unionByName(of_document(repeated, "repeated"))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that hold residue as content."""
    units_found = materialized(judged(documents))
    return units_found.select("doc_id").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that remain, all columns as they were; those with a null id or text remain too."""
    found = residue(documents).select(F.col("doc_id").alias("__found"))
    return documents.join(found, documents["doc_id"] == found["__found"], "left_anti")
