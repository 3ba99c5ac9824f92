"""Stems by published suffix rules, as SQL expressions over a table of distinct tokens.

A language is a list of steps; each is one column made from the ones before. A step looks for the longest of its endings
and does what that ending says: replace it, if it lies in a region of the word and what stands before it fits, and perhaps
take off more. Regions are places in the word: r1 is behind the first consonant after a vowel, r2 the same inside r1,
rv as the language says. Capitals mark vowels that count as consonants.

The statements are plain SQL; a ``Dialect`` spells the three regular-expression calls of an engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dialect(NamedTuple):
    """How an engine spells a test, a first match and a replacement of all matches ($1 is a group)."""

    matches: Callable[[str, str], str]
    first: Callable[[str, str], str]
    swap: Callable[[str, str, str], str]


SPARK = Dialect(
    lambda word, pattern: f"{word} RLIKE '{pattern}'",
    lambda word, pattern: f"regexp_extract({word}, '{pattern}', 0)",
    lambda word, pattern, new: f"regexp_replace({word}, '{pattern}', '{new}')",
)


class Ending(NamedTuple):
    """Endings that share a rule; ``more`` are pairs (what stands before, region) that go as well, the first that fits."""

    endings: str
    new: str = ""
    region: str | None = None
    before: str | None = None
    more: Sequence = ()


class More(NamedTuple):
    """An ending in front of one that was taken off: replaced in its region, else by ``other`` in ``other_region``."""

    endings: str
    region: str
    new: str = ""
    before: str | None = None
    other: str | None = None
    other_region: str | None = None
    more: Sequence = ()


def _fits(d: Dialect, stem: str, region: str | None, before: str | None) -> str:
    tests = [f"length({stem}) >= {region}"] if region else []
    tests += [d.matches(stem, f"(?:{before})$")] if before else []
    return " AND ".join(tests) or "TRUE"


def _more(d: Dialect, word: str, rules: Sequence[More]) -> str:
    """``word`` after the first of ``rules`` whose ending it has."""
    if not rules:
        return word
    cases = []
    for rule in rules:
        for end in sorted(rule.endings.split(), key=len, reverse=True):
            stem = f"left({word}, length({word}) - {len(end)})"
            done = _more(d, f"({stem} || '{rule.new}')" if rule.new else stem, rule.more)
            other = word
            if rule.other is not None:
                other = f"({stem} || '{rule.other}')"
                if rule.other_region:
                    other = f"CASE WHEN length({stem}) >= {rule.other_region} THEN {other} ELSE {word} END"
            cases.append(f"WHEN right({word}, {len(end)}) = '{end}' THEN CASE WHEN {_fits(d, stem, rule.region, rule.before)} THEN {done} ELSE {other} END")
    return f"CASE {' '.join(cases)} ELSE {word} END"


def longest(d: Dialect, word: str, rules: Sequence[Ending], within: str | None = None) -> str:
    """``word`` after the rule of its longest ending; with ``within`` only endings inside that region count."""
    flat = sorted(((end, rule) for rule in rules for end in rule.endings.split()), key=lambda x: -len(x[0]))
    cases = []
    for end, rule in flat:
        stem = f"left({word}, length({word}) - {len(end)})"
        inside = f" AND length({word}) - {len(end)} >= {within}" if within else ""
        done = _more(d, f"({stem} || '{rule.new}')" if rule.new else stem, rule.more)
        cases.append(f"WHEN right({word}, {len(end)}) = '{end}'{inside} THEN CASE WHEN {_fits(d, stem, rule.region, rule.before)} THEN {done} ELSE {word} END")
    return f"CASE {' '.join(cases)} ELSE {word} END"


def _after(d: Dialect, word: str, pattern: str, start: str = "0") -> str:
    """The place behind a match at the beginning of the rest of a word; without one, the word's end."""
    found = d.first(f"substr({word}, {start} + 1)", f"^(?:{pattern})")
    return f"CASE WHEN length({found}) > 0 THEN {start} + length({found}) ELSE length({word}) END"


def _regions(d: Dialect, vowels: str, first: str | None = None, least: int = 0) -> list[tuple[str, str]]:
    usual = f".*?[{vowels}][^{vowels}]"
    r1 = _after(d, "w", f"{first}|{usual}" if first else usual)
    return [("r1", f"greatest({r1}, least({least}, length(w)))" if least else r1), ("r2", _after(d, "w", usual, "r1"))]


def _romance_rv(d: Dialect, vowels: str) -> tuple[str, str]:
    # second letter a consonant: behind the next vowel; two vowels: behind the next consonant; else behind the third letter
    return "rv", _after(d, "w", f".[^{vowels}].*?[{vowels}]|[{vowels}][{vowels}].*?[^{vowels}]|[^{vowels}][{vowels}].")


def _plain(word: str, pairs: Sequence[tuple[str, str]]) -> str:
    for old, new in pairs:
        word = f"replace({word}, '{old}', '{new}')"
    return word


def _if_same(before: str, after: str, then: str) -> str:
    return f"CASE WHEN {before} = {after} THEN {then} ELSE {after} END"


# The published endings of each language, longest match first within a step.

ENGLISH_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
ENGLISH_STOP = "inning outing canning herring earring proceed exceed succeed"


def english(d: Dialect) -> list[tuple[str, str]]:
    v = "aeiouy"
    short = f"[^{v}][{v}][^{v}wxY]|^[{v}][^{v}]"
    ing = [Ending("eed eedly", "ee", "r1"), Ending("ed edly ing ingly", "", None, f"[{v}].*")]
    after = longest(d, "cut", [Ending("at", "ate"), Ending("bl", "ble"), Ending("iz", "ize"), *(Ending(x + x, x) for x in "bdfgmnprt")])
    fixed = " ".join(f"WHEN token = '{a}' THEN '{b}'" for a, b in ENGLISH_WHOLE.items())
    stops = ", ".join(f"'{x}'" for x in ENGLISH_STOP.split())
    return [
        ("bare", "CASE WHEN left(token, 1) = chr(39) THEN substr(token, 2) ELSE token END"),
        ("w0", "CASE WHEN right(bare, 3) = chr(39) || 's' || chr(39) THEN left(bare, length(bare) - 3) WHEN right(bare, 2) = chr(39) || 's' THEN left(bare, length(bare) - 2) WHEN right(bare, 1) = chr(39) THEN left(bare, length(bare) - 1) ELSE bare END"),
        ("w", d.swap("w0", f"(^|[{v}])y", "$1Y")),
        *_regions(d, v, "gener|commun|arsen"),
        ("a", longest(d, "w", [Ending("sses", "ss"), Ending("ied ies", "i", None, ".."), Ending("us ss", "", "length(w) + 1"), Ending("s", "", None, f"[{v}].+")])),
        ("b", f"CASE WHEN {d.matches('w', '^.(?:ied|ies)$')} THEN left(w, length(w) - 1) ELSE a END"),
        ("cut", longest(d, "b", ing)),
        ("c", f"CASE WHEN {d.matches('b', 'eed(?:ly)?$')} OR cut = b THEN cut WHEN {after} <> cut THEN {after} WHEN r1 >= length(cut) AND {d.matches('cut', f'(?:{short})$')} THEN cut || 'e' ELSE cut END"),
        ("e", longest(d, "c", [Ending("y Y", "i", None, f".[^{v}]")])),
        ("f", longest(d, "e", [
            Ending("tional", "tion", "r1"), Ending("enci", "ence", "r1"), Ending("anci", "ance", "r1"), Ending("abli", "able", "r1"), Ending("entli", "ent", "r1"),
            Ending("izer ization", "ize", "r1"), Ending("ational ation ator", "ate", "r1"), Ending("alism aliti alli", "al", "r1"), Ending("fulness fulli", "ful", "r1"),
            Ending("ousli ousness", "ous", "r1"), Ending("iveness iviti", "ive", "r1"), Ending("biliti bli", "ble", "r1"), Ending("ogi", "og", "r1", "l"),
            Ending("lessli", "less", "r1"), Ending("li", "", "r1", "[cdeghkmnrt]"),
        ])),
        ("g", longest(d, "f", [
            Ending("tional", "tion", "r1"), Ending("ational", "ate", "r1"), Ending("alize", "al", "r1"), Ending("icate iciti ical", "ic", "r1"),
            Ending("ful ness", "", "r1"), Ending("ative", "", "r2"),
        ])),
        ("h", longest(d, "g", [Ending("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", "", "r2"), Ending("ion", "", "r2", "[st]")])),
        ("i", f"CASE WHEN right(h, 1) = 'e' AND (length(h) > r2 OR (length(h) > r1 AND NOT {d.matches('left(h, length(h) - 1)', f'(?:{short})$')})) THEN left(h, length(h) - 1) WHEN right(h, 2) = 'll' AND length(h) > r2 THEN left(h, length(h) - 1) ELSE h END"),
        ("stem", f"CASE WHEN length(token) < 3 THEN token {fixed} WHEN b IN ({stops}) THEN b ELSE replace(i, 'Y', 'y') END"),
    ]


def german(d: Dialect) -> list[tuple[str, str]]:
    v = "aeiouyäöü"
    # between vowels; twice, because neighbouring matches share a vowel
    marked = _plain("token", [("ß", "ss")])
    for _ in range(2):
        marked = d.swap(d.swap(marked, f"([{v}])u([{v}])", "$1U$2"), f"([{v}])y([{v}])", "$1Y$2")
    return [
        ("w", marked),
        *_regions(d, v, least=3)[:1],
        ("p1", _after(d, "w", f".*?[{v}][^{v}]")),
        ("r2", _after(d, "w", f".*?[{v}][^{v}]", "p1")),
        ("a", longest(d, "w", [Ending("em ern er", "", "r1"), Ending("e en es", "", "r1", None, [More("niss", "0", "nis")]), Ending("s", "", "r1", "[bdfghklmnrt]")])),
        ("b", longest(d, "a", [Ending("en er est", "", "r1"), Ending("st", "", "r1", "...[bdfghklmnt]")])),
        ("c", longest(d, "b", [
            Ending("end ung", "", "r2", None, [More("ig", "r2", "", "^|[^e]")]), Ending("ig ik isch", "", "r2", "^|[^e]"),
            Ending("lich heit", "", "r2", None, [More("er en", "r1")]), Ending("keit", "", "r2", None, [More("lich ig", "r2")]),
        ])),
        ("stem", _plain("c", [("U", "u"), ("Y", "y"), ("ä", "a"), ("ö", "o"), ("ü", "u")])),
    ]


SPANISH_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
    "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
ACUTE = [("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u")]


def spanish(d: Dialect) -> list[tuple[str, str]]:
    v = "aeiouáéíóúü"
    pronouns = "me se sela selo selas selos la le lo las les los nos"
    bare = "left(w, length(w) - length(pro))"

    def behind(end: str) -> str:
        return f"length(pro) > 0 AND right({bare}, {len(end)}) = '{end}' AND length({bare}) - {len(end)} >= rv"

    accents = " ".join(f"WHEN {behind(e)} THEN left({bare}, length({bare}) - {len(e)}) || '{new}'" for e, new in [("iéndo", "iendo"), ("ándo", "ando"), ("ár", "ar"), ("ér", "er"), ("ír", "ir")])
    plains = " ".join(f"WHEN {behind(e)} THEN {bare}" for e in ("ando", "iendo", "ar", "er", "ir"))
    yendo = f"WHEN {behind('yendo')} AND right({bare}, 6) = 'uyendo' THEN {bare}"
    return [
        ("w", "token"),
        *_regions(d, v),
        _romance_rv(d, v),
        ("pro", _ending_of("w", pronouns, "rv")),
        ("a", f"CASE {accents} {plains} {yendo} ELSE w END"),
        ("b", longest(d, "a", [
            Ending("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", "", "r2"),
            Ending("adora ador ación adoras adores aciones ante antes ancia ancias", "", "r2", None, [More("ic", "r2")]),
            Ending("logía logías", "log", "r2"), Ending("ución uciones", "u", "r2"), Ending("encia encias", "ente", "r2"),
            Ending("amente", "", "r1", None, [More("iv", "r2", "", None, None, None, [More("at", "r2")]), More("os ic ad", "r2")]),
            Ending("mente", "", "r2", None, [More("ante able ible", "r2")]),
            Ending("idad idades", "", "r2", None, [More("abil ic iv", "r2")]),
            Ending("iva ivo ivas ivos", "", "r2", None, [More("at", "r2")]),
        ])),
        ("c", _if_same("a", "b", longest(d, "b", [Ending("ya ye yan yen yeron yendo yo yó yas yes yais yamos", "", None, "u")], "rv"))),
        ("e", f"CASE WHEN a <> b OR b <> c THEN c ELSE {longest(d, 'c', [Ending('en es éis emos', '', None, None, [More('gu', '0', 'g')]), Ending(SPANISH_VERBS)], 'rv')} END"),
        ("f", longest(d, "e", [Ending("os a o á í ó", "", "rv"), Ending("e é", "", "rv", None, [More("gu", "rv - 1", "g")])])),
        ("stem", _plain("f", ACUTE)),
    ]


def _ending_of(word: str, endings: str, within: str) -> str:
    """The longest of the endings that a word has inside a region, or nothing."""
    cases = " ".join(f"WHEN right({word}, {len(e)}) = '{e}' AND length({word}) - {len(e)} >= {within} THEN '{e}'" for e in sorted(endings.split(), key=len, reverse=True))
    return f"CASE {cases} ELSE '' END"


ITALIAN_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai "
    "eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo "
    "irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita "
    "ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)
ITALIAN_PRONOUNS = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela "
    "cele celi celo cene vela vele veli velo vene"
)


def italian(d: Dialect) -> list[tuple[str, str]]:
    v = "aeiouàèìòù"
    marked = _plain("token", [("á", "à"), ("é", "è"), ("í", "ì"), ("ó", "ò"), ("ú", "ù"), ("qu", "qU")])
    for _ in range(2):
        marked = d.swap(d.swap(marked, f"([{v}])u([{v}])", "$1U$2"), f"([{v}])i([{v}])", "$1I$2")
    bare = "left(w, length(w) - length(pro))"
    after = lambda ends: " OR ".join(f"(right({bare}, {len(e)}) = '{e}' AND length({bare}) - {len(e)} >= rv)" for e in ends)
    return [
        ("w", marked),
        *_regions(d, v),
        _romance_rv(d, v),
        ("pro", _ending_of("w", ITALIAN_PRONOUNS, "rv")),
        ("a", f"CASE WHEN length(pro) > 0 AND ({after(['ando', 'endo'])}) THEN {bare} WHEN length(pro) > 0 AND ({after(['ar', 'er', 'ir'])}) THEN {bare} || 'e' ELSE w END"),
        ("b", longest(d, "a", [
            Ending("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti", "", "r2"),
            Ending("azione azioni atore atori", "", "r2", None, [More("ic", "r2")]),
            Ending("logia logie", "log", "r2"), Ending("uzione uzioni usione usioni", "u", "r2"), Ending("enza enze", "ente", "r2"),
            Ending("amento amenti imento imenti", "", "rv"),
            Ending("amente", "", "r1", None, [More("iv", "r2", "", None, None, None, [More("at", "r2")]), More("abil os ic", "r2")]),
            Ending("ità", "", "r2", None, [More("abil ic iv", "r2")]),
            Ending("ivo ivi iva ive", "", "r2", None, [More("at", "r2", "", None, None, None, [More("ic", "r2")])]),
        ])),
        ("c", _if_same("a", "b", longest(d, "b", [Ending(ITALIAN_VERBS)], "rv"))),
        ("e", longest(d, "c", [Ending("a e i o à è ì ò", "", "rv", None, [More("i", "rv")])])),
        ("f", longest(d, "e", [Ending("ch", "c", "rv"), Ending("gh", "g", "rv")])),
        ("stem", _plain("f", [("U", "u"), ("I", "i")])),
    ]


PORTUGUESE_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram "
    "eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias "
    "irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis "
    "eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos "
    "áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


def portuguese(d: Dialect) -> list[tuple[str, str]]:
    v = "aeiouáéíóúâêô"
    return [
        ("w", _plain("token", [("ã", "a~"), ("õ", "o~")])),
        *_regions(d, v),
        _romance_rv(d, v),
        ("a", longest(d, "w", [
            Ending("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", "", "r2"),
            Ending("logia logias", "log", "r2"), Ending("uça~o uço~es", "u", "r2"), Ending("ência ências", "ente", "r2"),
            Ending("amente", "", "r1", None, [More("iv", "r2", "", None, None, None, [More("at", "r2")]), More("os ic ad", "r2")]),
            Ending("mente", "", "r2", None, [More("ante avel ível", "r2")]),
            Ending("idade idades", "", "r2", None, [More("abil ic iv", "r2")]),
            Ending("iva ivo ivas ivos", "", "r2", None, [More("at", "r2")]),
            Ending("ira iras", "ir", "rv", "e"),
        ])),
        ("b", _if_same("w", "a", longest(d, "a", [Ending(PORTUGUESE_VERBS)], "rv"))),
        ("c", f"CASE WHEN b <> w THEN {longest(d, 'b', [Ending('i', '', 'rv', 'c')])} ELSE {longest(d, 'b', [Ending('os a i o á í ó', '', 'rv')])} END"),
        ("e", longest(d, "c", [Ending("e é ê", "", "rv", None, [More("gu", "rv - 1", "g"), More("ci", "rv - 1", "c")]), Ending("ç", "c")])),
        ("stem", _plain("e", [("a~", "ã"), ("o~", "õ")])),
    ]


FRENCH_I_VERBS = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant "
    "issante issantes issants isse issent isses issez issiez issions issons it"
)
FRENCH_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
FRENCH_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def french(d: Dialect) -> list[tuple[str, str]]:
    v = "aeiouyâàëéêèïîôûù"
    marked = d.swap("token", "qu", "qU")
    for _ in range(2):
        marked = d.swap(d.swap(marked, f"([{v}])u([{v}])", "$1U$2"), f"([{v}])i([{v}])", "$1I$2")
    marked = d.swap(d.swap(marked, f"([{v}])y", "$1Y"), f"y([{v}])", "Y$1")
    iv = More("iv", "r2", "", None, None, None, [More("at", "r2")])
    vowel = f"[{v}]"
    return [
        ("w", marked),
        *_regions(d, v),
        ("rv", _after(d, "w", f"[{v}][{v}].|par|col|tap|.[^{v}]*[{v}]")),
        ("a", longest(d, "w", [
            Ending("ance iqUe isme able iste eux ances iqUes ismes ables istes", "", "r2"),
            Ending("atrice ateur ation atrices ateurs ations", "", "r2", None, [More("ic", "r2", "", None, "iqU")]),
            Ending("logie logies", "log", "r2"), Ending("usion ution usions utions", "u", "r2"), Ending("ence ences", "ent", "r2"),
            Ending("ement ements", "", "rv", None, [iv, More("eus", "r2", "", None, "eux", "r1"), More("abl iqU", "r2"), More("ièr Ièr", "rv", "i")]),
            Ending("ité ités", "", "r2", None, [More("abil", "r2", "", None, "abl"), More("ic", "r2", "", None, "iqU"), More("iv", "r2")]),
            Ending("if ive ifs ives", "", "r2", None, [More("at", "r2", "", None, None, None, [More("ic", "r2", "", None, "iqU")])]),
            Ending("eaux", "eau"), Ending("aux", "al", "r1"), Ending("issement issements", "", "r1", f"[^{v}]"),
            Ending("amment", "ant", "rv"), Ending("emment", "ent", "rv"),
            Ending("ment ments", "", "rv + 1", vowel), Ending("euse euses", "", "r2"),
        ])),
        ("b", f"CASE WHEN a = w AND {d.matches('w', 'euses?$')} THEN {longest(d, 'w', [Ending('euse euses', 'eux', 'r1')])} ELSE a END"),
        # adverbs go on to the verb endings as well
        ("again", f"b = w OR {d.matches('w', '[^e]ments?$')}"),
        ("c", f"CASE WHEN again THEN {longest(d, 'b', [Ending(FRENCH_I_VERBS, '', 'rv + 1', f'[^{v}]')], 'rv')} ELSE b END"),
        ("e", f"CASE WHEN again AND c = b THEN {longest(d, 'c', [Ending('ions', '', 'r2'), Ending(FRENCH_E_VERBS), Ending(FRENCH_A_VERBS, '', None, None, [More('e', 'rv')])], 'rv')} ELSE c END"),
        ("lean", f"CASE WHEN {d.matches('e', '[^aiouès]s$')} THEN left(e, length(e) - 1) ELSE e END"),
        ("f", f"CASE WHEN NOT again OR e <> b THEN {longest(d, 'e', [Ending('Y', 'i'), Ending('ç', 'c')])} ELSE {longest(d, 'lean', [Ending('ion', '', 'r2', '[st]'), Ending('ier ière Ier Ière', 'i'), Ending('e'), Ending('ë', '', None, 'gu')], 'rv')} END"),
        ("g", longest(d, "f", [Ending("enn", "en"), Ending("onn", "on"), Ending("ett", "et"), Ending("ell", "el"), Ending("eill", "eil")])),
        ("stem", _plain(d.swap("g", f"[éè]([^{v}]+)$", "e$1"), [("I", "i"), ("U", "u"), ("Y", "y")])),
    ]


STEMMERS = {"de": german, "en": english, "es": spanish, "fr": french, "it": italian, "pt": portuguese}


def stems(tokens: DataFrame, language: str) -> DataFrame:
    """(token, stem) of a table of lower-case tokens; give each token once. Tokens of other alphabets stay as they are."""
    if language not in STEMMERS:
        raise ValueError(f"no stemming rules for {language!r}; there are {sorted(STEMMERS)}")
    made = tokens.select("token")
    for name, sql in STEMMERS[language](SPARK):
        made = made.withColumn(name, F.expr(sql))
    return made.select("token", "stem")
