"""Template residue, filler, error pages and script notices in place of content (problem 9)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import written

# --- slots of templates -------------------------------------------------------------------

#: What the slots of project templates are named after (words in any case, joined by blank, _, - or case).
SLOT_NAMES = (
    r"years?|authors?|owners?|e[-_ ]?mails?|maintainers?|company|organi[sz]ation|description|package|version|licen[cs]e|date|full[-_ ]?name|"
    r"user[-_ ]?name|copyright[-_ ]?(?:holder|owner|year)s?|repo(?:sitory)?[-_ ]?(?:url|name)|"
    r"(?:app(?:lication)?|service|class|module|project|package|product|company|author|your)[-_ ]?(?:title|name|url|slug|description|version)"
)
_N = rf"(?:(?:scaffold|project|template|cookiecutter)\.)?(?:{SLOT_NAMES})"
#: Ways in which templates mark a slot.
SLOT_FORMS = (
    rf"\{{\{{-?\s*{_N}\s*-?\}}\}}",
    rf"\{{%-?\s*{_N}\s*-?%\}}",
    rf"\[%\s*{_N}\s*%\]",
    rf"<%=?\s*{_N}\s*%>",
    rf"\$\{{{_N}\}}",
    rf"#\{{{_N}\}}#?",
    rf"@@{_N}@@",
    rf"%%{_N}%%",
    rf"\$\${_N}\$\$",
    rf"(?:^|[^$(])\(\({_N}\)\)",
    rf"«\s*{_N}\s*»",
    rf"(?:^|[^A-Za-z0-9_])__{_N}__",
    rf"\[{_N}\]",
    rf"<(?:insert[-_ ]|your[-_ ]|the[-_ ]){_N}(?:[-_ ]here)?>",
    rf"<{_N}[-_ ]here>",
    rf"&lt;\s*(?:insert[-_ ]|your[-_ ])?{_N}(?:[-_ ]here)?\s*&gt;",
    rf"YOUR_{_N}_HERE",
)
_SLOT = re.compile("|".join(f"(?:{f})" for f in SLOT_FORMS), re.I)
_SLOT_RE2 = "(?i)" + "|".join(f"(?:{f})" for f in SLOT_FORMS)
#: Files that are templates or views themselves, by where they lie, what they are called or what they hold.
_TEMPLATE_PATH = re.compile(r"(?:^|/)(?:templates|views|scaffolds?|cookiecutter[^/]*)/|\.(?:tmpl|tpl|j2|jinja2?|erb|ejs|hbs|mustache|vue|svelte|liquid|in)$", re.I)
_TEMPLATE_TEXT = re.compile(r"\{%-?\s*(?:extends|block|for|if|include|macro|end\w*)\b|\{\{-?\s*(?:range|if|with|define|template|end|\.[A-Z])|<%[^=\n][^\n]*%>|<template>|v-for=")
_CODE_SPAN = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_INLINE = re.compile(r"(?<!`)`[^`\n]+`(?!`)")

# --- statements that stand where content should ----------------------------------------------

_JS = r"(?:(?:client[- ]side\s+)?(?:java\s?script|js|scripts?|scripting))"
#: What is said about scripts where they are required.
_NEED = r"(?:turn|switch|enabl|activat|allow|requir|need|necess|disabl|block|unblock|off\b|not\s+load|did\s+not|without|support|permit|must|unavailable)"
STATEMENTS: dict[str, str] = {
    "script": rf"""
        ^[^:=]{{0,80}}\b{_JS}\b(?=.{{0,120}}{_NEED})(?=.*[.!]) | ^[^:=]{{0,80}}{_NEED}\w*\b.{{0,60}}\b{_JS}\b[^;=(){{}}]{{0,80}}[.!]
      | ^(?:please\s+|you\s+(?:need|have)\s+to\s+|to\s+continue,?\s+)?(?:turn\s+on|enable|activate|allow|switch\s+on)\s+{_JS}\b
      | ^(?:this|the|our|your)\s+[\w\s-]{{0,40}}?(?:does\s+not|doesn't|cannot|can't|won't|will\s+not)\s+(?:start|run|work|load|function|show|support)\b.{{0,60}}\b{_JS}\b
      | ^(?:this|the|our|your|please|you)\b.{{0,60}}\b(?:requires?|needs?|must|have\s+to)\b.{{0,30}}\b{_JS}\b
      | ^(?:client[- ]side\s+)?{_JS}\s+(?:(?:and\s+\w+\s+)?(?:is|are|has|have|must|needs?|seems?)\s+(?:to\s+be\s+)?(?:disabled|required|needed|necessary|off|turned|enabled|allowed|not|switched|blocked))
      | ^your\s+browser\s+(?:does\s+not|doesn't|has|is|cannot)\b.{{0,60}}\b(?:{_JS}|switched\s+off|turned\s+off|disabled|blocked)
      | \benable\s+scripts\s+and\s+cookies\b | ^this\s+takes\s+a\s+few\s+seconds\b.*\b(?:scripts|cookies)\b | ^checking\s+your\s+browser\b
      | \bconfirm\s+that\s+you\s+are\s+a\s+(?:person|human)\b | ^(?:verify|prove)\s+(?:that\s+)?you\s+are\s+(?:a\s+)?human
      | ^(?:cette|ce|votre|veuillez|diese|dieser|bitte|esta|este|por\s+favor|questo|questa|per\s+favore|este\s+site)\b.*\bjavascript\b
      | ^javascript\s+(?:habilitado|est|ist|wird|muss|doit|debe|è|deve|é|necess)\b
      | ^(?:\w+\s+){{0,3}}(?:js|javascript)\s+is\s+(?:disabled|off|required)\b""",
    "error": r"""
        ^(?:error\s*:?\s*|http(?:/[\d.]+)?\s+|status\s*:?\s*)?[45]\d\d\s*[:|-]?\s+(?:bad|not|too|service|gateway|internal|forbidden|gone|unauthori[sz]ed|request|conflict|method|payload|unavailable|proxy|precondition|moved|page|error)\b[\w\s]{0,30}[.!]?$
      | ^(?:404|page|file|seite|datei|página|page|site|pagina)\s+(?:not\s+found|nicht\s+gefunden|introuvable|no\s+encontrad|non\s+trovat|não\s+encontrad)
      | ^(?:the\s+)?(?:page|file|resource|document|site|url|address)\b.{0,50}\b(?:not\s+(?:be\s+)?found|does\s+not\s+exist|doesn't\s+exist|no\s+longer\s+exists?|was\s+not\s+found|has\s+(?:moved|been\s+(?:moved|removed|deleted)))
      | ^la\s+(?:p\S{1,4}gina|page)\b.*\b(?:no\s+existe|n'existe|retirada)\b | \bn'existe\s+pas\b | ^servi\S{1,3}o\b.*\bindispon | ^service\b.*\bindisponible | ^(?:dienst|der\s+dienst)\b.*nicht\s+verf
      | ^(?:страница|файл|документ)\b.*\bне\s+(?:найден|существ) | ^ошибка\b | ^сервис\b.*\bнедоступ | ^(?:pagina|bestand)\b.*\bniet\s+gevonden | ^nie\s+znaleziono
      | ページが見つかりません | 页面不存在 | 找不到 | 服务暂时不可用 | 페이지를\s+찾을\s+수
      | ^(?:oops\b.{0,20})?sorry,?\s+we\s+(?:can't|cannot|could\s+not|couldn't)\s+find\b | ^oops\b.*\b(?:find|wrong|missing|moved)\b
      | ^(?:the\s+)?(?:site|server|service|system|page)\s+is\s+(?:currently\s+|temporarily\s+)?(?:down|offline|unavailable|under\s+maintenance|overloaded)\b | \bdown\s+for\s+(?:scheduled\s+)?maintenance\b
      | ^(?:something|an?\s+(?:unexpected\s+)?error)\s+(?:broke|went\s+wrong|occurred|happened|failed)\b
      | ^you\s+have\s+(?:sent|made|exceeded)\b.*\b(?:requests|limit|quota)\b | ^rate\s+limit\b.*\bexceeded
      | ^access\s+(?:blocked|denied|forbidden)\b | ^(?:the\s+)?policy\s+of\s+your\s+network\b | ^you\s+(?:do\s+not|don't)\s+have\s+permission\b
      | ^(?:sign|log)\s+in\b.*\bsession\b | ^your\s+session\s+(?:has\s+)?(?:expired|timed\s+out)\b
      | ^upstream\s+(?:closed|connect|timed|request)\b | ^(?:connection|request|operation)\s+(?:reset|refused|timed\s+out|closed|aborted)\b | ^(?:no|cannot|could\s+not|unable\s+to|failed\s+to)\s+(?:establish\s+)?connect(?:ion)?\b.*\b(?:made|established|database|server|refused|to)\b
      | ^(?:the\s+)?\w+\s+you\s+asked\s+for\s+cannot\s+be\s+served\b | ^(?:accessdenied|slowdown|expiredrequest|nosuch\w+|internalerror|serviceunavailable|invalid\w+)\s
      | ^this\s+[\w-]+\s+has\s+been\s+(?:disabled|suspended|removed|blocked|locked)\b.*\b(?:because|quota|contact|owner)\b
      | ^remote\s+said:\s | ^fetch\s+gave\s+up\b | ^(?:fatal|remote)\s*:\s+(?:repository|could\s+not|unable|not\s+found|no\s+such)
      | ^(?:warning|fatal\s+error|parse\s+error|notice)\s*:\s+(?:out\s+of\s+memory|\w+\(\)\s+expects|allowed\s+memory|maximum\s+execution|uncaught|undefined|call\s+to)
      | ^\w*(?:exception|error)\s+in\s+\S+\s+(?:on\s+)?line\s+\d+ | ^traceback\s+\(most\s+recent
      | ^\{\s*"(?:message|error|status|code|errors)"\s*:.*"?(?:status|code|error)"?\s*:?\s*"?[45]\d\d\b.*\}\s*$""",
    "filler": r"""
        \blorem\s+ipsum\s+(?!dolor\s+sit\s+amet['"\\]) | ^(?:section\s+\d+\s*:\s*)?(?:your|insert|add|put|write)\s+(?:your\s+)?(?:text|content|description|title|paragraph|words?)\s+(?:here|goes)\b
      | ^(?:text|content|description|title|body)\s+(?:goes|comes|to\s+be\s+(?:added|done|written))\b | ^type\s+something\s+here\b | ^(?:replace|edit|change)\s+this\s+(?:text|paragraph|section|file)\b
      | ^(?:content|more|details|documentation|description|page|text)?\s*coming\s+soon\b | ^(?:description|content|text|details|documentation|more)\s+(?:to\s+follow|will\s+follow|follows?\s+(?:soon|later|shortly))\b
      | ^this\s+(?:section|page|file|document|text|part)\s+(?:will\s+be|is\s+to\s+be|has\s+yet\s+to\s+be)\s+(?:written|added|filled|completed)\b | ^this\s+(?:page|file|space|section)\s+(?:is\s+)?(?:intentionally|deliberately)\s+(?:left\s+)?(?:blank|empty)\b
      | ^(?:dummy|placeholder|empty)\s+(?:file|text|content|page|document)\b.{0,80}$ | ^(?:to\s+be\s+(?:written|done|added|completed)|tbd|n/?a)\s*[.!]?$ | ^nothing\s+to\s+see\b
      | ^contenu\s+\S{1,3}\s*venir | ^hier\s+folgt\b | ^(?:inhalt|text)\s+folgt | ^próximamente\b | ^contenido\s+(?:por|en|próx) | ^em\s+breve\b | ^conteúdo\s+em | ^in\s+arrivo\b | ^prossimamente\b | ^à\s+compléter\b
      | ^(?:item|point|entry|title|heading|paragraph|example)\s+\d+[.:]?$""",
}
_STATEMENT = {k: re.compile(v, re.I | re.X) for k, v in STATEMENTS.items()}
_TAG = re.compile(r"<[^<>]*>")
#: Tags that end a block of words, all but those within a sentence.
_BLOCK = re.compile(r"<(?!/?(?:a|abbr|b|big|cite|code|del|dfn|em|font|i|ins|kbd|label|mark|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr)\b)[^<>]*>", re.I)
_MARKERS = re.compile(r"^(?:(?://+!?|#+!?|/\*+|\*+/?|<!--+|--+|;+|%+|\"\"\"|'''|>+|[-*+]\s|\d+[.)]\s)\s*)+|\s*(?:\*+/|--+>|\"\"\"|''')\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TRAILER = re.compile(r"^(?:ray|reference|ref|request(?:\s?id)?|incident|ticket|trace|id|event)?[\s:#-]*(?:[\w.-]+\.invalid\s+)?[0-9a-f][0-9a-f-]{4,}\s*$|^[\w.-]+/\d[\d.]*$|^[\w.-]+\.(?:invalid|com|net|org)\b.{0,40}$|^try\s+again\b.{0,60}$|^loading\b.{0,40}$|^[45]\d\d\b.{0,40}$", re.I)
_TAG_ONLY = re.compile(r"^(?:\s*<[^<>]*>)+\s*$")
_CODE = re.compile(r"[{};=]\s*$|^\s*(?:return|import|from|def|func|fn|let|var|const|public|private|class|if|for|while|select|create|insert)\b|\w\(.*\)\s*[;:{]|:=|=>|->|\+=")
#: Words of the usual dummy Latin (fixed values).
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit "
    "esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: What rules across a page are drawn with.
RULES = frozenset(".-_=*~ ")
#: A line about such texts rather than one of them.
_MENTION = re.compile(r"^(?:if|when|where|a\s+page|an?\s+(?:error|answer|reply|message)|error\s+\d+\s+means|in\s+a|see)\b|\bmeans\s+that\b|\bcomes\s+from\b", re.I)
_TODO = re.compile(r"^(?:todo|fixme|xxx|hack|note)\b", re.I)

_HIDDEN = re.compile(r"<(script|style)\b[^<>]*>.*?</\1\s*>|<!--.*?-->", re.I | re.S)
#: What a page does not show where scripts run.
_UNSHOWN = re.compile(r"<(script|style|noscript)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
_FIRST_LINE = re.compile(r"\S[^\r\n]*")
_CALL, _CALL_END = re.compile(r"\w\("), re.compile(r"\)\s*[;:{]")
_CODE_BUT_CALLS = re.compile(_CODE.pattern.replace(r"|\w\(.*\)\s*[;:{]", ""))


@dataclass(frozen=True)
class ResidueConfig:
    """``low_info``: a text of at most so many distinct terms says little. ``hosts``/``slugs``: so many
    distinct repositories and file names with the same low-information response make it one of
    some machine rather than something written. ``shared``: a response of which at least this share
    of neighbouring words is known from such responses is one too. ``overlap``: a response with
    this share of its terms from the file's own address belongs to the file. ``statements``: whether
    the catalogue of known sentences counts; without it only the evidence of the corpus itself does."""

    low_info: int = 80
    hosts: int = 3
    slugs: int = 3
    shared: float = 0.6
    overlap: float = 0.5
    statements: bool = True


def terms(s: str) -> set[str]:
    return {w.lower() for w in _PART.findall(s) if len(w) > 2}


def plain(line: str) -> str:
    """A line without tags, comment markers and list marks."""
    s = line.strip().removeprefix("\ufeff").removeprefix("ï»¿")  # a byte order mark, also one decoded wrongly
    if s[:1].isalpha() and s[-1] not in "/>\"'" and "<" not in s:
        return " ".join(s.split())  # no marks
    if "<" in s:
        s = _TAG.sub(" ", s.replace("<!--", " ").replace("-->", " "))
    s = s.strip()
    for _ in range(3):
        t = _MARKERS.sub("", s).strip()
        if t == s:
            break
        s = t
    return re.sub(r"\s+", " ", s)


def coded(s: str) -> bool:
    """``_CODE`` in one line, in linear time: from the first call on, one end of a call is enough."""
    return bool(_CODE_BUT_CALLS.search(s) or ((call := _CALL.search(s)) and _CALL_END.search(s, call.end())))


def repeated(s: str, blocks: int = 1) -> bool:
    """Words typed over and over, keys hit at random, or one character in a row.

    Words that only come again from one to another of a page's ``blocks``, as in rows of a table, are not typed over.
    """
    bare = s.replace(" ", "")
    if len(bare) >= 10 and len(set(bare.lower())) <= 2 and (bare[0].isalnum() or bare[0] == "."):
        return True
    latin = [w for w in re.findall(r"[a-z]+", s.lower()) if w in LATIN]
    if len(latin) >= 6 and len(latin) >= 0.8 * len(_WORD.findall(s)) and not re.search(r"[=(){}\[\]<>]", s):
        return True
    words = [w.lower() for w in re.findall(r"[^\s]+", s)]
    bare_words = [w.rstrip(";,.") for w in words]
    if len(words) >= 6 and all(w.isalpha() and len(w) <= 8 for w in bare_words) and sum(not set(w) & set("aeiouy") for w in bare_words) >= 0.5 * len(words):
        return True
    if len(words) >= 8 and all(len(w) <= 10 for w in words) and not re.search(r"[=(){}\[\]<>\d]", s):
        return len(set(words)) <= max(2, len(words) // (4 * max(blocks, 1))) and Counter(words).most_common(1)[0][1] >= 3
    return False


def statement(line: str, catalogue: bool = True) -> str | None:
    """The kind of residue that a whole line is, or none; without the ``catalogue`` only by its repeated words.

    A page on one line is one by any of the pieces that it shows, whatever the length of the line.
    """
    raw = line.strip()
    if "<" in raw:
        raw = _UNSHOWN.sub(" ", raw).strip()
    if raw.startswith("{"):
        if not catalogue:
            return None
        return "error" if raw.endswith("}") and _STATEMENT["error"].search(raw) else None
    s = plain(raw)
    if not s:
        return None
    blocks = [b for x in _BLOCK.split(raw.replace("<!--", " ").replace("-->", " ")) if (b := plain(x))] if "<" in raw else [s]
    if repeated(s, len(blocks)) or (len(blocks) > 1 and repeated(s) and any(map(repeated, blocks))):
        return "filler"
    if not catalogue:
        return None
    if _MENTION.search(s) or ("<" not in raw and coded(s)):
        return None
    for kind, rx in _STATEMENT.items():
        if rx.search(s):
            return kind
    if "<" in raw:  # a page on one line: judge its pieces
        for piece in _TAG.split(raw):
            p = plain(piece)
            for kind, rx in _STATEMENT.items():
                if p and not _MENTION.search(p) and rx.search(p):
                    return kind
    return None


def tail_of(text: str) -> Iterator[str]:
    """The lines that are not blank, last first, as far as they are asked for."""
    end = len(text)
    while end > 0:
        start = text.rfind("\n", 0, end) + 1
        line = text[start:end]
        if line.strip():
            yield line
        end = start - 1


def pieces(line: str) -> Iterator[str]:
    """The visible pieces of a line with tags, last first."""
    return (x for x in reversed(_TAG.split(_HIDDEN.sub(" ", line))) if x.strip())


def silent(raw: str, s: str) -> bool:
    """Markup, a reference or a rule: a line (``s`` without its marks) that says nothing itself."""
    return not s or (s[0] in RULES and set(s) <= RULES) or bool(_TRAILER.match(s) or ("<" in raw and _TAG_ONLY.match(raw.strip())))


def judge_tail(tail: Iterable[str], catalogue: bool = True) -> tuple[str | None, tuple[str, str]]:
    """The kind of residue that the text ends in, and the tail's own words: of its whole lines, and of what lines with tags end in.

    What follows the statement may only be markup, a reference number or more of the same: a
    text that goes on with content merely mentions it. ``tail`` has the last line first. A line
    with tags, however long, is judged both as a whole and by its pieces as if they were lines.
    """
    kind, at, seen = None, 0, []
    for raw in tail:
        s = plain(raw)
        ended, (_, end) = judge_tail(pieces(raw), catalogue) if s and raw.lstrip()[0] != "{" and _TAG.search(raw) else (None, (s, s))
        k = statement(raw, catalogue) or ended
        seen.append((raw, s, end if ended or not k else s))
        if k:
            kind, at = k, len(seen)
            continue
        if silent(raw, s):
            continue
        if kind and len(s.split()) <= 3 and not coded(s):
            continue
        break
    if kind:
        return kind, (" ".join(s for _, s, _ in seen[:at][::-1]), " ".join(end for _, _, end in seen[:at][::-1]))
    return None, next(((s, end) for raw, s, end in seen if not silent(raw, s)), ("", ""))


def low_body(text: str, most: int) -> str | None:
    """The visible words of the whole text without markup and references, if they have at most ``most`` distinct terms."""
    said: list[str] = []
    have: set[str] = set()
    text = _HIDDEN.sub(" ", text) if "<" in text else text
    end, n = 0, len(text)
    while end < n:
        start, end = end, text.find("\n", end) + 1 or n
        raw = text[start:end]
        s = plain(raw)
        if silent(raw, s):
            continue
        have.update([w.lower() for w in _PART.findall(s) if len(w) > 2])
        if len(have) > most:
            return None
        said.append(s)
    return " ".join(said)


def spoken(words: str) -> bool:
    """Whether words read like speech."""
    parts = words.split()
    return len(parts) >= 3 and bool(_WORD.search(words)) and not coded(words) and not _TODO.match(words) and sum(w.strip(".,;:!?'\"()").isalpha() for w in parts) >= 0.7 * len(parts)


def skeleton(words: str, own: set[str]) -> str:
    """A response without what differs from place to place: numbers (0), names, and terms of the file's own address (#)."""
    out: list[str] = []
    for w in words.split():
        w = w.strip(".,;:!?'\"()[]{}<>")
        if any(c.isdigit() for c in w):
            w = "0"
        elif not w.isalpha() or (w[1:] != w[1:].lower() and w != w.upper()) or w.lower() in own:
            w = "#" if w else ""
        if w and not (w == "0" and out and out[-1] == "0"):
            out.append(w.lower())
    return " ".join(out)


_HEADINGS = re.compile(r"<(title|h1)\b[^<>]*>([^<>]*)</\1\s*>", re.I)


def judge_page(text: str, path: str) -> tuple[str | None, str]:
    """The kind of a page whose title or first heading is a statement, whatever menus and footers surround it."""
    if not text.lstrip("\ufeff \t\r\n").startswith("<"):
        return None, ""
    for m in _HEADINGS.finditer(text):
        kind = statement(m.group(2))
        if kind and not set(re.findall(r"[45]\d\d", m.group(2))) & set(re.findall(r"[45]\d\d", path)):
            return kind, plain(m.group(2))
    return None, ""


def unfilled_slots(text: str, path: str) -> int:
    """Slots never filled in a text that is no template itself and does not quote or explain slots."""
    if _TEMPLATE_PATH.search(path) or _TEMPLATE_TEXT.search(text):
        return 0
    found = list(_SLOT.finditer(text))
    if not found:
        return 0
    if any(_SLOT.search(m.group(0)) for m in _INLINE.finditer(text)):  # a document that explains slots
        found = list(_SLOT.finditer(_CODE_SPAN.sub("", text)))
    n = 0
    for m in found:
        s = m.group(0)
        lo = m.string.rfind("\n", 0, m.start() + 1) + 1
        hi = m.string.find("\n", m.end())
        line = m.string[lo : hi if hi >= 0 else len(m.string)]
        if s.startswith("${") and (line.count("`") >= 2 or re.match(r"\s*(?:export\s+)?[A-Za-z_]\w*=|.*\b(?:echo|exec|printf)\b", line)):
            continue  # the language's own substitution
        if s.startswith("#{") and not s.endswith("#") and re.search(r"\"[^\"]*#\{", line):
            continue
        if "__" in s and re.match(r"\s*#\s*(?:define|ifn?def|undef|if|endif)\b", line):
            continue
        if s.startswith("[") and re.search(r"[\w)\]]$", line[: m.start() - lo]):
            continue  # an index
        n += 1
    return n


EVIDENCE = (
    "_id bigint, _host string, _slug string, kind string, slots int, mismatch boolean, low_info boolean, said array<string>"
)


def _evidence(low_info: int, overlap: float, statements: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(3), "")
            may_slot = pc.match_substring_regex(texts, _SLOT_RE2).to_pylist()
            cols: list[list] = [[] for _ in range(5)]
            slugs = []
            for text, path, host, slot in zip(texts.to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist(), may_slot):
                path = path or ""
                kind, (words, end) = judge_tail(tail_of(text), statements)
                body = low_body(text, low_info)
                if statements and kind is None and body is not None:
                    kind, heading = judge_page(text, path)
                    words, end = (heading, heading) if heading else (words, end)
                n = unfilled_slots(text, path) if slot else 0
                title = m.group() if (m := _FIRST_LINE.search(text)) else ""
                own = terms(path)
                foreign = not own & terms(title)
                said = terms(end)
                low = len(said) <= low_info if kind else body is not None
                mismatch = foreign and (not own & (said if kind else terms(body if low else text)) if kind or n else True)
                own |= terms(host)
                responses = []
                for x in dict.fromkeys((words, end, body or "")):  # in place of the remainder (last line, end of a page on one line), and of the whole
                    if spoken(x) and len(have := terms(x)) <= low_info and len(own & have) <= overlap * len(have):
                        responses.append(skeleton(x, own))
                for c, v in zip(cols, (kind, n, mismatch, low, responses)):
                    c.append(v)
                slugs.append(path.rsplit("/", 1)[-1])
            types = (pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(slugs, pa.string()), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=[x.split()[0] for x in EVIDENCE.split(", ")],
            )

    return run


def find_residue(
    docs: DataFrame,
    cfg: ResidueConfig = ResidueConfig(),
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "repo",
    path: str = "path",
) -> DataFrame:
    """Documents with residue in place of content: ``(doc_id, kind, slots, mismatch, low_info, hosts)``.

    ``kind`` is ``placeholder`` (a slot that was never filled), ``script``, ``error``,
    ``filler``, or ``duplicate`` (a response known by its spread alone).

    One pass over the whole texts gives narrow evidence. A response is what stands in place of
    the remainder (the last line above markup and references, what it ends in if it has tags, or
    the statement that ends the text) or of the whole (all visible words), if it says little, reads like speech and is not
    made of the terms of the file's own address; without numbers, names and those terms it is a
    skeleton. Host evidence is combined over all files: a skeleton in files of many names in many
    repositories is a machine's response, and the neighbouring words of such skeletons, each
    known from many repositories, make the vocabulary of responses. A file is residue by it if its
    response is spread so itself, or if most of its neighbouring words belong to that
    vocabulary (``shared``), so that wordings seen once are found by their likeness to spread ones.

    Detectors add what is not said in sentences or is rare: unfilled slots anywhere in the text,
    repeated words and dummy Latin, and statements at the end of a text or in a page's title,
    which count where the tail says little or shares no term with the address.

    Skeletons are counted by (skeleton, repository, file name), combined before they are shuffled;
    scoring goes by distinct skeletons, and flagged ones, few, are joined back. The evidence,
    without rows that have none, is written to the shared folder once.

    Defined cases: null and empty texts are no residue; a null path or repository counts as
    the empty name; repeated rows and copies of a case are cases, each by its own evidence;
    very long texts are read whole for slots and from their end for statements, up to the first line of content; an empty table
    gives no rows. Only named columns are read.
    """
    slim = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(path).alias("_path"), F.col(text).alias("_text"))
    ev = slim.mapInArrow(_evidence(cfg.low_info, cfg.overlap, cfg.statements), EVIDENCE).where("kind is not null or slots > 0 or size(said) > 0")
    ev = written(ev, "evidence")  # read for the counts and for the verdicts, so that texts are gone through once
    known = responses(ev, cfg)
    # At most three responses a row, so each way of the join has a row at most; rows without any stay out of it.
    asked = ev.where("size(said) > 0").withColumns({f"_s{k}": F.coalesce(F.get("said", F.lit(k)), F.get("said", F.lit(0))) for k in range(3)})
    for k in range(3):
        asked = asked.join(known.select(F.col("skeleton").alias(f"_s{k}"), F.col("hosts").alias(f"_h{k}"), F.col("shared").alias(f"_p{k}")), f"_s{k}", "left")
    asked = asked.withColumns({"hosts": F.greatest("_h0", "_h1", "_h2"), "shared": F.greatest("_p0", "_p1", "_p2")})
    keep = ["_id", "kind", "slots", "mismatch", "low_info", "hosts", "shared"]
    rest = ev.where("size(said) = 0").withColumns({"hosts": F.lit(None).cast("bigint"), "shared": F.lit(None).cast("double")})
    out = asked.select(*keep).unionByName(rest.select(*keep))
    said = F.when(F.col("mismatch") | F.col("low_info") | F.col("shared").isNotNull(), F.col("kind"))
    verdict = F.coalesce(said, F.when(F.col("slots") > 0, "placeholder"), F.when(F.col("shared").isNotNull(), "duplicate"))
    return (
        out.withColumn("kind", verdict)
        .where("kind is not null")
        .select(F.col("_id").alias(doc_id), "kind", "slots", "mismatch", "low_info", F.coalesce("hosts", F.lit(1).cast("bigint")).alias("hosts"), F.coalesce("shared", F.lit(0.0)).alias("shared"))
    )


def responses(ev: DataFrame, cfg: ResidueConfig = ResidueConfig()) -> DataFrame:
    """``(skeleton, hosts, shared)`` of the skeletons that host evidence takes for a machine's response.

    ``hosts`` counts repositories; ``shared`` is the share of neighbouring words that belong to the
    vocabulary of spread responses (1 for those that are spread themselves).
    """
    one = ev.select(F.explode("said").alias("skeleton"), "_host", "_slug").distinct()
    spread = one.groupBy("skeleton").agg(F.count_distinct("_host").alias("hosts"), F.count_distinct("_slug").alias("_slugs"))
    spread = written(spread.withColumn("_spread", (F.col("hosts") >= cfg.hosts) & (F.col("_slugs") >= cfg.slugs)), "skeletons")
    w = F.split("skeleton", " ")
    pairs = F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda x, y: F.concat_ws(" ", x, y)))
    split = lambda x: x.where(F.size(w) > 1).withColumn("pair", F.explode(pairs))
    # A pair is known from many repositories: its skeletons' hosts, distinct before they are counted.
    vocabulary = (
        split(one.select("skeleton", "_host").distinct().join(spread.where("_spread").select("skeleton"), "skeleton"))
        .select("pair", "_host").distinct().groupBy("pair").agg(F.count("*").alias("_n")).where(F.col("_n") >= cfg.hosts).select("pair", F.lit(1).alias("_in"))
    )
    # Written, so that its size is known: a small one goes to the skeletons, and their many pairs are not shuffled.
    vocabulary = written(vocabulary, "vocabulary")
    score = split(spread.where("not _spread").select("skeleton")).join(vocabulary, "pair", "left").groupBy("skeleton").agg(F.avg(F.coalesce("_in", F.lit(0))).alias("_share"))
    out = spread.join(score, "skeleton", "left").withColumn("shared", F.when(F.col("_spread"), 1.0).otherwise(F.coalesce("_share", F.lit(0.0))))
    return written(out.where(F.col("shared") >= cfg.shared).select("skeleton", "hosts", "shared"), "responses")
