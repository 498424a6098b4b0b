"""Trusted patterns of template residue, filler and delivery messages."""

from __future__ import annotations

import re
from functools import lru_cache

try:
    import ahocorasick
except ImportError:  # the triggers are then looked for one by one
    ahocorasick = None

#: Names that template fields of catalogue records carry.
FIELD_WORDS = (
    "title book_title short_title subtitle author author_name author_bio name first_name last_name full_name customer user username "
    "desc description short_desc long_desc blurb synopsis summary tagline headline teaser excerpt text body content copy "
    "series series_name volume genre category publisher imprint price currency isbn date year pub_date format pages page_count "
    "language translator editor rating review product product_name item item_name company brand url link image cover keyword keywords audience"
).split()

_F = "(?:" + "|".join(sorted(FIELD_WORDS, key=len, reverse=True)) + ")"
_ID = r"[A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+)*"

PLACEHOLDERS = [
    r"\{\{[^{}\n]{1,60}\}\}",
    r"\{%[^{}\n]{1,60}%\}",
    r"<%=?[^<>\n]{1,60}%>",
    r"\$\{[^{}\n]{1,60}\}",
    r"\[\[\s*" + _ID + r"\s*\]\]",
    r"@@\s*" + _ID + r"\s*@@",
    r"<<\s*" + _ID + r"\s*>>",
    r"%(?:(?i:" + _F + r")|[A-Z]+_[A-Z_]+)%",
    r"\$(?:(?i:" + _F + r")|[A-Z]+_[A-Z_]+)\$",
    r"#(?:(?i:" + _F + r")|[A-Z]+_[A-Z_]+)#",
    r"__(?:(?i:" + _F + r")|[A-Z]+_[A-Z_]+)__",
    r"(?<![{%$])\{\s*(?:(?i:" + _F + r")|[a-z]+_[a-z_]+|[A-Z]+_[A-Z_]+|[A-Z]{3,}|\d)\s*\}(?![}%])",
    r"\[\s*(?i:insert|your|enter|add|type)\s+(?i:the\s+|a\s+|an\s+)?[A-Za-z_ ]{2,40}\]",
    r"\[\s*[A-Za-z_ ]{2,40}\s(?i:to\s+come|goes\s+here|here|tbd|tbc|tk)\s*\]",
    r"<\s*(?i:insert|your|enter)\s+[A-Za-z_ ]{2,40}>",
    r"<\s*(?i:" + _F + r")\s+here\s*>",
    r"&lt;\s*(?i:" + _F + r")(?:\s+here)?\s*&gt;",
    r"\[\s*[A-Z]+(?:_[A-Z]+)*\s*\](?=.*\[\s*[A-Z]+(?:_[A-Z]+)*\s*\])",
    r"\[object Object\]",
    r"\b(?:is|by|from|of|for|dear|hello|hi) (?:undefined|null|NaN|None)\b(?= pages|[,.!]| is| by|$)",
]

UNFINISHED = [
    r"\b(?:TBC|TBD|TODO|TK TK|TKTK|FIXME|XXX)\s*[:\-–]\s*\S",
    r"(?m)^\W*(?:TBC|TBD|TODO|FIXME|TK|TK TK|TKTK|[Tt]bc|[Tt]bd)\W*$",
    r"(?i)\b(?:final copy pending|blurb to follow|copy from marketing|ask editor for text|(?:description|text|copy|blurb|synopsis|summary) (?:to be (?:added|supplied|provided|confirmed|written)|coming soon|forthcoming|to come|goes here|pending))\b(?!\s+(?:in|to|of)\b)",
    r"\b(?i:write|enter|add|type|insert|put|place)\s(?:(?i:a|an|the|your|short|long|brief|full|main)\s)*(?i:product|item|book|short|long|title|series|author|publisher|edition)\s(?:(?i:product|item|book)\s)?(?i:description|summary|text|blurb|synopsis|copy|details|information|name)\shere\b",
    r"(?i)^\W*(?:no )?(?:description|synopsis|blurb|summary) (?:is )?(?:not )?(?:yet )?(?:available|provided|found)\W*$",
    r"(?i)\b(?:this is )?(?:a |an )?(?:sample|placeholder|dummy|default) (?:text|description|copy|blurb|content)\b(?=\W*$| (?:for|to be|that will|goes|only))",
]

FILLER = [
    r"(?i)\blorem ipsum\b",
    r"(?i)\b(?:dolor sit amet|consectetur adipiscing|sed do eiusmod|ut labore et dolore|magna aliqua)\b",
    r"(?i)\b(?:dummy|filler|sample|placeholder|test|quick sample|quick)\s?(?:paragraph|copy|text|entry|block|sentence|sample|line|record|content|description|blurb|title)?\s+(?:number|no\.?|#)\s*\d+",
    r"(?i)\b(?:to be replaced before launch|used for layout tests? only|for checking the page width)\b",
    r"(?i)\b(?:dummy|test|sample|placeholder|filler) (?:entry|book|record|product|item|text|description|copy|blurb|paragraph|content|title|summary)(?: do not (?:buy|order|delete|use))?\s*\d+",
    r"(?i)\btest (?:book|product|item|record),? (?:please )?do not (?:buy|order|delete|use)\b",
    r"(?i)\b(bla+h?|yada|asdf|qwer|qwerty|test|abc|xyz|foo|bar|hjkl|dummy|xx+)\b(?:\W+\1\b){2,}",
    r"(?i)\basdf(?:gh?j?k?l?)?\b|\bqwerty(?:u?i?o?p?)?\b|\bzxcvb(?:nm?)?\b",
    r"(?i)\b(\w{2,})\b(?:\s+\1\b){4,}",
]

_CODE = r"(?:4(?:0[0-9]|1[0-9]|29|5[01])|5(?:0[0-9]|1[01]))"
_SCRIPTS = r"(?:java\s?script|js|cookies?|scripts?|scripting|client-side scripts?)"

MESSAGES = [
    # status codes and their phrases
    r"(?i)^\W*(?:http\s*)?(?:error|status)?\s*" + _CODE + r"\W+(?:not found|page not found|access denied|forbidden|bad gateway|gateway|gone|service|internal|unauthori[sz]ed|too many|rate limit|the |you |we |this |unexpected|request|server|temporarily|log|sign)",
    r"(?i)\b(?:error|erreur|fehler|errore|erro|fout)\s*[:#]?\s*" + _CODE + r"\b",
    r"(?i)\b(?:http|status)\s+" + _CODE + r"\b",
    r"(?i)\(code \w{3,}\)|\bquote incident\b|\bincident (?:id )?(?=[0-9a-f]*\d)[0-9a-f]{5,}\b|\bVorgang (?=[0-9a-f]*\d)[0-9a-f]{4,}|\bréf\. (?=[0-9a-f]*\d)[0-9a-f]{4,}|\breference (?=[0-9a-f]*\d)[0-9a-f]{5,}\W*$",
    r"(?i)<h1>[^<]{2,60}</h1>\s*<p>the request for\b|\bthe request for /\S+ could not be completed",
    r"(?i)\boops!? (?:something|that|we|the|unexpected|too many|page|access|internal|bad|gateway|rate|you|this)\b.{0,80}\b(?:error|wrong|page|request|offline|denied|unavailable|server|removed|maintenance|slow down|permission|code)\b",
    # failures of programs
    r"(?i)\bmysql_\w+\(\)|\bORA-\d{5}\b|\bSQLSTATE\b|\btraceback\b.{0,20}(?:most recent call|:\s*\w+(?:Error|Exception))|\b(?:Key|Type|Value|Attribute|Index|Name|Runtime|NullPointer|Template)(?:Error|Exception)\b|\bundefined (?:index|variable|method|property)\b|\bsyntax error\b.{0,20}\bline \d|\bfatal error:|\bwarning: \w+\(\)|^\W*stack trace\b",
    # whole lines
    r"(?i)^\W*(?:403|404|500|502|503)\W+(?:access denied|page not found|not found)",
    r"(?i)^\W*(?:(?:access|permission) denied|(?:page |file )?not found|service unavailable|forbidden|gone|unauthori[sz]ed|bad request|internal error|server error|request timed out|timed out)\W*$",
    # scripts and cookies
    r"(?i)\b(?:please |to go on |to continue |you (?:must|need to) |in order to \w+ (?:this|the) (?:page|item|content|text),? )?(?:enable|activate|allow|turn on|switch on) (?:both )?" + _SCRIPTS + r"(?: and " + _SCRIPTS + r")?\b(?=.{0,40}(?:browser|display|view|see|continue|reload|proceed|read|refresh|\[|$))",
    r"(?i)\b(?:this \w+|the (?:page|widget|site|shop|item|content|section)) (?:needs|requires) " + _SCRIPTS + r"(?: and " + _SCRIPTS + r")?\b(?=\W*$|,? (?:which|to|and|please|but)\b|[.;(])",
    r"(?i)\byou have " + _SCRIPTS + r" (?:disabled|switched off|turned off|blocked)\b",
    r"(?i)\byour (?:browser|settings?) (?:may be |is |are )?(?:block\w*|disabl\w*|(?:does|do) not (?:support|allow))\b",
    r"(?i)\b" + _SCRIPTS + r"(?: and " + _SCRIPTS + r")? (?:must be (?:turned on|enabled|activated|allowed|switched on)|(?:is|are) (?:required|disabled|switched off|turned off|needed))\b(?=\s*(?:to |;|\.|,? update|,? which|in your|\(|$))",
    r"(?i)<noscript>",
    r"(?i)\b(?:veuillez )?activer " + _SCRIPTS + r"\b|\b" + _SCRIPTS + r" aktivieren\b|\b(?:active|habilite|activar|habilitar|ative|ativar) " + _SCRIPTS + r"\b|\b(?:attivare|abilitare|attiva|abilita) " + _SCRIPTS + r"\b|\b(?:schakel|zet) " + _SCRIPTS + r" (?:in|aan)\b|\b" + _SCRIPTS + r" (?:inschakelen|in te schakelen)\b",
]

#: Phrases that a novel may hold too: they count where they are half of the segment or more, or
#: where the segment carries a number such as a system gives its cases.
PROSE = [
    r"(?i)\b(?:search the shop|contact support)\W*$",
    r"(?i)\b(?:internal|unexpected) server error\b|\b(?:the )?upstream server sent an invalid (?:reply|response)\b|\bgateway time-?out\b|\bbad gateway\b|\brate limit exceeded\b|\btoo many requests\b",
    r"(?i)^\W*(?:the )?request timed out\b.*",
    r"(?i)\bwe can(?:'|’)?t find that page\b|\byou do not have permission to view\b(?: (?:this|the) \w+)?|\b(?:we are|this \w+ is|the \w+ is|site) (?:down|closed) for (?:scheduled |planned )?maintenance\b",
    r"(?i)\b(?:the |this |our )?(?:site|page|service|catalogue|catalog|server|shop|store|system) is (?:temporarily|currently) (?:offline|unavailable|down)\b|\b(?:scheduled|planned) maintenance\b",
    r"(?i)\bthis (?:page|item|record|product|listing) (?:is no longer (?:available|listed|active|in stock|for sale|here|online|found)|has been (?:removed|deleted)|does not exist|no longer exists)\b",
    r"(?i)\b(?:the )?page you (?:requested|are looking for)(?: (?:does not exist|was not found|could not be found|cannot be found|has been \w+|is \w+|no longer exists))?",
    r"(?i)\bcette page n(?:'|’)existe plus\b|\bpage introuvable\b|\baccès refusé\b|\bservice (?:momentanément|temporairement) indisponible\b|\bsite en maintenance\b",
    r"(?i)\bzugriff verweigert\b|\bdiese seite existiert nicht\b|\bseite (?:wurde )?nicht gefunden\b|\bwartungsarbeiten\b|\bvorübergehend nicht (?:erreichbar|verfügbar)\b",
    r"(?i)\bpágina no encontrada\b|\bacceso denegado\b|\besta página (?:ya )?no existe\b|\bservicio no disponible\b|\ben mantenimiento\b",
    r"(?i)\bpágina não encontrada\b|\bacesso negado\b|\besta página (?:já )?não existe\b|\bem manutenção\b|\bpagina non trovata\b|\baccesso negato\b|\bquesta pagina non esiste\b|\bin manutenzione\b|\bpagina niet gevonden\b|\btoegang geweigerd\b|\bdeze pagina bestaat niet\b|\bin onderhoud\b",
    r"(?i)\bsomething went wrong (?:on our (?:side|end)|while|\W*$|here|with (?:your|this) (?:request|page))|\b(?:try|load) (?:again|the page again) (?:later|in a few minutes)\W*$",
    # logins and checks
    r"(?i)\byour session (?:has )?(?:ended|expired|timed out)\b|\b(?:log|sign) in (?:again )?to (?:see|view|read|continue|access)|\bplease (?:log|sign) in\b|\byou must be logged in\b|\bcomplete the (?:check|captcha)\b",
    r"(?i)\b(?:veuillez vous (?:re)?connecter|bitte (?:erneut )?anmelden|inicie sesión|faça login|effettua(?:re)? (?:il|l(?:'|’))\s?(?:login|accesso)|log (?:opnieuw )?in om)\b",
]

#: What says nothing by itself: it counts where every other segment of the record is residue too.
WEAK = [
    r"(?i)^\W*(?:are you a robot|(?:verify|prove) (?:that )?you are (?:human|not a robot))\W*$",
    r"^(?:\s*([_\-=*#~.xX])\1{7,})+\s*$",
]

FAMILIES = {"placeholder": PLACEHOLDERS, "unfinished": UNFINISHED, "filler": FILLER, "message": MESSAGES}
_COMPILED = {name: [re.compile(p) for p in patterns] for name, patterns in FAMILIES.items()}
_PROSE, _WEAK = [re.compile(p) for p in PROSE], [re.compile(p) for p in WEAK]

#: A number as a system gives its cases, and the part of a segment that a phrase of ``PROSE`` fills without one.
_CASE = re.compile(r"\b(?=[a-z]*\d)(?=\d*[a-z])[0-9a-z]{4,}\b|\b\d{5,}\b|\b(?:item|record|reference|incident|page|id|query) [0-9a-f]{5,8}\b|\b" + _CODE + r"\b", re.I)
PROSE_COVER = 0.5

#: Stems of the usual Latin filler; its words come cut short and with other endings.
LATIN_STEMS = "lore ipsu dolo amet cons adip sedo eius temp inci labo labi magn aliq enim quis nost ulla nisi comm fusc nunc pell inte veli posu morb vita ultr orna dict maur prae viva susp null euis phas done curs".split()


def latin_filler(segment: str) -> bool:
    """Whether six words or more are nearly all of the usual Latin filler."""
    words = [w.lower() for w in _WORDS.findall(segment)]
    return len(words) >= 6 and sum(w[:4] in _STEMS for w in words) >= 0.85 * len(words)


_STEMS = frozenset(LATIN_STEMS)
_HOME, _UPPER, _LOWER = set("asdfghjkl"), set("qwertyuiop"), set("zxcvbnm")
_WORDS = re.compile(r"[A-Za-z]+")


#: Letters in an order that no word has them.
_IMPLAUSIBLE = re.compile(r"([a-z])\1\1|[bcdfghjklmnpqrstvwxz]{5}|[dfghjkls]{4}|[zxcvbnm]{4}|[qwrtp]{4}|ii|uu|yy|ww|qq|q(?!u)|[aeiou]{4}")


def keyboard_noise(segment: str) -> bool:
    """Whether a segment is nearly all key runs: lower case words of one row or without vowels.

    One of them must have letters in an order that no word has, as some words lie in one row.
    """
    words = _WORDS.findall(segment)
    runs = [w for w in words if w.islower() and ((len(w) >= 5 and (set(w) <= _HOME or set(w) <= _LOWER)) or (len(w) >= 7 and set(w) <= _UPPER) or (len(w) >= 6 and not set(w) & set("aeiouy")))]
    return bool(runs) and sum(map(len, runs)) >= 0.8 * sum(map(len, words)) and any(_IMPLAUSIBLE.search(w) for w in runs)


#: Every rule needs one of these in the text in lower case, or a sign matched by ``_SIGNS``.
TRIGGERS = (
    "cookie|script| js |>js | here|tbc|tbd|todo:|todo -|fixme|xxx|tk tk|tktk|pending|blurb to|from marketing|for text|to be added|to be suppl|to be prov|to be conf|to be writ|to be repl|coming soon|forthcoming|to come|goes here|"
    "placeholder|dummy|filler|sample|default |lorem|ipsum|dolor sit|consectetur|eiusmod|ut labore|magna aliqua|asdf|qwer|zxcv|layout test|page width|"
    "error|erreur|fehler|errore|erro |erro:|fout |fout:|http|status |(code|reference |incident|vorgang|réf.|the request for|oops|search the shop|contact support|"
    "mysql_|ora-|sqlstate|traceback|exception|undefined|null|nan|none|fatal error|warning:|stack trace|server|gateway|rate limit|too many requests|timed out|"
    "find that page|permission|maintenance|is temporarily|is currently|closed for|this listing|this page|this item|this record|this product|page you|"
    "cette page|introuvable|accès refusé|indisponible|zugriff|existiert nicht|nicht gefunden|wartungsarbeiten|vorübergehend nicht|no encontrada|denegado|esta página|no disponible|"
    "en mantenimiento|não encontrada|negado|em manutenção|non trovata|negato|questa pagina|in manutenzione|niet gevonden|geweigerd|deze pagina|in onderhoud|"
    "denied|not found|unavailable|forbidden|unauthori|bad request|went wrong|again later|again in a|your session|log in|sign in|logged in|robot|captcha|you are human|complete the check|upstream server|scheduled main|planned main|"
    "connecter|anmelden|inicie sesión|faça login|effettua|log opnieuw|your browser|your setting|activ|aktiv|habilit|ativ|abilit|attiv|inschakelen|test book|test product|test item|test record|test entry|do not buy|"
    "not available|not yet|not provided|no description|no synopsis|no blurb|no summary|description is|is null|<noscript"
).split("|")
#: Signs that ask for a closer look wherever they stand, and those that need more around them.
SIGNS = "{ } [ ] % $ # @ << <% <? &lt; __ -- == ** ~~ .... xxxxxxxx".split() + ["test "]
_TAGS = re.compile(r"<h\d|<[A-Za-z ]+ here|<\s*(?i:insert|your|enter)")
_NUMBERED = re.compile(r"(?:number|no\.?)\s*\d")
_SCRIPT_WORD = re.compile(r"\bjs\b")
_DIGIT = re.compile(r"\d")
_SHORT = re.compile(r"(?i)^\W*(?:gone|not found|tk|tbc|tbd|todo|fixme|xxx|timed out|js .*)\W*$|^\W*\d{3}\W|[.!?>\n]\s*\d{3}\W+[A-Za-z]|\W{3}js\b")
_ROWS = re.compile(r"\b(?:[asdfghjkl]{5,}|[qwertyuiop]{7,}|[zxcvbnm]{5,}|[b-df-hj-np-tv-xz]{6,})\b")
_STEM_SIGNS = [w for w in LATIN_STEMS if w not in {"inte", "cons", "comm", "done", "temp", "null"}]


_TWICE = re.compile(r"(?<!\w)(\w+)\W+\1(?!\w)")


def _automaton():
    if ahocorasick is None:
        return None
    found = ahocorasick.Automaton()
    for w in _STEM_SIGNS:
        found.add_word(w, w)
    for w in [*TRIGGERS, *SIGNS]:  # a stem that is a trigger, too, counts as that
        found.add_word(w, "")
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def _has_trigger(lower: str) -> bool:
    """Whether a text in lower case has a trigger, a sign or three stems of Latin filler."""
    if _AUTOMATON is None:
        return any(w in lower for w in TRIGGERS) or any(w in lower for w in SIGNS) or sum(w in lower for w in _STEM_SIGNS) >= 3
    stems = set()
    for _, stem in _AUTOMATON.iter(lower):
        if not stem:
            return True
        stems.add(stem)
        if len(stems) >= 3:
            return True
    return False


def may_hold_residue(segment: str) -> bool:
    """A cheap test that no segment with a label fails."""
    lower = segment.lower()
    if _has_trigger(lower) or _ROWS.search(lower) or _TWICE.search(lower) is not None:
        return True
    if "<" in lower and _TAGS.search(segment) or "js" in lower and _SCRIPT_WORD.search(lower):
        return True
    has_digit = _DIGIT.search(lower) is not None
    return has_digit and _NUMBERED.search(lower) is not None or (has_digit or len(segment) < 40) and _SHORT.search(segment) is not None


def segment_match(segment: str) -> tuple[str, str, bool] | None:
    """Family of a residue segment, the part of it that the pattern matched, and whether the
    pattern alone tells: a system's message does, whatever else its segment says."""
    for name, patterns in _COMPILED.items():
        for p in patterns:
            m = p.search(segment)
            if m:
                return name, m.group(), name == "message"
    if keyboard_noise(segment) or latin_filler(segment):
        return "filler", segment.strip(), True
    length, case = len(segment.strip()), bool(_CASE.search(segment))
    for p in _PROSE:
        for m in p.finditer(segment):
            if case or len(m.group()) >= PROSE_COVER * length:
                return "message", m.group(), False
    if any(p.search(segment) for p in _WEAK):
        return "weak", segment.strip(), False
    return None


@lru_cache(1 << 16)
def _remembered_match(segment: str) -> tuple[str, str, bool] | None:
    """The same behind the cheap test; sentences come again and again."""
    return segment_match(segment) if may_hold_residue(segment) else None


def record_matches(segments: list[str]) -> list[tuple[str, str, bool] | None]:
    """The match of every segment of a record; weak ones count only in a record that holds nothing else and teach nothing."""
    found = [_remembered_match(s) for s in segments]
    alone = all(found)
    return [f if f is None or f[0] != "weak" else ("filler", "", False) if alone else None for f in found]


def segment_label(segment: str) -> tuple[str, float] | None:
    """Family of a residue segment and the share of it that the pattern covers."""
    found = segment_match(segment)
    return found and (found[0], len(found[1]) / max(1, len(segment.strip())))
