"""Markup residue: documents' token streams become wrappers by host, which then parse the documents to clean text."""

from __future__ import annotations

import html
import json
from collections import Counter
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import spread

ELEMENTS = ("heading", "list", "table", "code", "formula", "other")

# Names that HTML, MediaWiki and LaTeX give their structures.
LIST_TAGS = "ul ol li dl dt dd menu"
TABLE_TAGS = "table thead tbody tfoot tr td th caption colgroup col"
OTHER_TAGS = "a abbr acronym address article aside b base bdi bdo big blockquote body br button center cite code dfn del details div em embed figcaption figure font footer form frame frameset header head hr html i iframe img input ins kbd label legend link main mark meta nav noscript nowiki object option p param picture poem q ref references ruby rp rt s samp section select small source span strike strong sub summary sup svg textarea title tt u video audio wbr gallery includeonly noinclude"
MATH_ENVIRONMENTS = "equation align gather multline eqnarray displaymath math alignat flalign"
CODE_ENVIRONMENTS = "verbatim lstlisting minted Verbatim alltt"
LIST_ENVIRONMENTS = "itemize enumerate description"
TABLE_ENVIRONMENTS = "tabular tabularx table longtable array"
HEADING_COMMANDS = "part chapter section subsection subsubsection paragraph subparagraph"
BARE_COMMANDS = "maketitle noindent newpage clearpage bigskip medskip smallskip tableofcontents centering hline toprule midrule bottomrule LaTeX TeX ldots dots par appendix"
ROLES = "user assistant tool system"


def _any(names: str) -> str:
    return "|".join(sorted(names.split(), key=len, reverse=True))


#: Spans whose inside isn't read as markup, the first that begins wins.
OPAQUE = regex.compile(
    rf"""(?=[`~<\\$])(?:(?P<fence>(?m:(?<=^[ ]{{0,3}})(?P<tick>`{{3,}}|~{{3,}})[^\n`]*\n(?:(?s:.*?)\n)??[ ]{{0,3}}(?P=tick)[ \t\r]*$))
    |(?P<comment><!--(?s:.*?)-->)
    |(?P<script><(?P<drop>script|style)\b[^<>]*>(?s:.*?)</(?P=drop)\s*>)
    |(?P<pre><(?P<block>pre|source|syntaxhighlight)\b[^<>]*>(?s:.*?)</(?P=block)\s*>)
    |(?P<math><math\b[^<>]*>(?s:.*?)</math\s*>)
    |(?P<nowiki><nowiki>(?s:.*?)</nowiki>)
    |(?P<verbatim>\\begin\{{(?P<cenv>{_any(CODE_ENVIRONMENTS)})\*?\}}(?s:.*?)\\end\{{(?P=cenv)\*?\}})
    |(?P<equation>\\begin\{{(?P<menv>{_any(MATH_ENVIRONMENTS)})\*?\}}(?s:.*?)\\end\{{(?P=menv)\*?\}})
    |(?P<display>\$\$(?s:[^$]+?)\$\$|\\\[(?s:.+?)\\\])
    |(?P<paren>\\\((?:[^\n]|\n(?!\s*\n))+?\\\))
    |(?P<dollar>(?<![\\$\w])\$(?=[^\s$"'])(?=[^$\n"']*[\\^_={{}}])[^$\n"']*[^\s$\\"']\$(?![\d$\w]))
    |(?P<verb>\\verb\*?(?P<bar>[^\w\s*])[^\n]*?(?P=bar))
    |(?P<inline>(?<!`)(?P<grave>`{{1,2}})(?!`)[^`\n]+(?<!`)(?P=grave)(?!`)))
    """,
    regex.X | regex.I,
)
KINDS = {"fence": "code", "pre": "code", "verbatim": "code", "math": "formula", "equation": "formula", "display": "formula", "paren": "formula", "dollar": "formula"}

#: Tokens of lines with opaque spans.
BLOCKS = {"code": "codeblock", "formula": "formula"}

INLINE = regex.compile(
    rf"""(?=[<&\\!\[{{'*_~])(?:(?P<tag></?(?P<name>h[1-6]|{_any(LIST_TAGS)}|{_any(TABLE_TAGS)}|{_any(OTHER_TAGS)}|pre|syntaxhighlight|math|script|style)(?:\s[^<>]*|=[^<>\s]*)?/?>|<!DOCTYPE[^<>]*>)
    |(?P<escaped>&lt;/?[A-Za-z][A-Za-z0-9]*(?:\s(?:(?!&[lg]t;)[^\n])*)?/?&gt;)
    |(?P<entity>&(?:[A-Za-z][A-Za-z0-9]{{1,30}}|\#\d{{1,7}}|\#[xX][0-9a-fA-F]{{1,6}});)
    |(?P<env>\\(?:begin|end)\{{(?P<ename>[A-Za-z]+)\*?\}}(?:\[[^\]\n]*\])?(?:\{{[^{{}}\n]*\}})?)
    |(?P<head>\\(?P<level>{_any(HEADING_COMMANDS)})\*?(?:\[[^\]\n]*\])?\{{(?P<htext>(?:[^{{}}\n]|\{{[^{{}}\n]*\}})*)\}})
    |(?P<item>(?<=^[ \t]*)\\item\b(?:\[[^\]\n]*\])?[ \t]*)
    |(?P<command>\\(?P<cname>[A-Za-z]{{2,}})\*?(?:\[[^\]\n]*\])?\{{(?P<ctext>(?:[^{{}}\n]|\{{[^{{}}\n]*\}})*)\}})
    |(?P<bare>\\(?:{_any(BARE_COMMANDS)})\b)
    |(?P<image>!\[(?P<alt>[^\]\n]*)\](?:\((?:[^()\n]|\([^()\n]*\))*\)|\[[^\]\n]*\]))
    |(?P<wiki>\[\[(?P<wtarget>[^\[\]|\n]+)(?:\|(?P<wtext>[^\[\]\n]*))?\]\])
    |(?P<template>\{{\{{[^{{}}\n]+(?:\n[^{{}}]*)?\}}\}})
    |(?P<define>(?<=^[ ]{{0,3}})\[(?P<dname>\^?[^\]\n]+)\]:[ \t]+(?P<dtext>[^\n]*))
    |(?P<link>(?<![\w\]\)])\[(?P<ltext>[^\[\]\n]+)\]\((?P<lurl>[^()\s]+)(?:\s+"[^"\n]*")?\))
    |(?P<reflink>(?<![\w\]\)])\[(?P<rtext>[^\[\]\n]*[^\W\d][^\[\]\n]*)\]\[(?P<rname>[^\[\]\n]*)\])
    |(?P<foot>(?<!^)\[\^[^\]\s]+\])
    |(?P<external>\[(?:https?|ftp)://[^\s\]]+(?:[ ](?P<xtext>[^\]\n]*))?\])
    |(?P<auto><(?:https?|ftp|mailto):[^<>\s]+>)
    |(?P<quoted>'{{2,5}}(?P<qtext>[^'\n](?:[^\n]*?[^'\n])?)'{{2,5}})
    |(?P<strong>(?<![\w*])\*\*(?P<stext>[^\s*](?:[^*\n]*[^\s*])?)\*\*(?![\w*]))
    |(?P<under>(?<!\w)__(?P<utext>[^\s_](?:[^\n]*?[^\s_])?)__(?![\w(]))
    |(?P<struck>(?<![~\w])~~(?P<ktext>[^\s~](?:[^~\n]*[^\s~])?)~~(?![~\w]))
    |(?P<emphasis>(?<![\w*])\*(?P<etext>[^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*]))
    |(?P<slant>(?<![\w_/\\.])_(?P<itext>[^\s_](?:[^_\n]*[^\s_])?)_(?![\w_])))
    """,
    regex.X | regex.I | regex.M,
)

ROLE = regex.compile(rf"(?:{_any(ROLES)}): ")
LINES = (
    ("rule", regex.compile(r"[ ]{0,3}(?:-[ \t]*){3,}$|[ ]{0,3}(?:\*[ \t]*){3,}$|[ ]{0,3}(?:_[ \t]*){3,}$")),
    ("underline", regex.compile(r"[ ]{0,3}(?:={2,}|-{2,})[ \t]*$")),
    ("atx", regex.compile(r"[ ]{0,3}#{1,6}[ \t]+\S.*$")),
    ("wikihead", regex.compile(r"(={1,6})[^=\n].*?\1[ \t]*$")),
    ("wikitable", regex.compile(r"[ \t]*(?:\{\||\|\}|\|-(?!.*\|\s*$)|\|\+|\|[^|\n]*\|\|[^|\n]|![ ]?\S.*!!|!\s)")),
    ("divider", regex.compile(r"[ ]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|[ ]{0,3}\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$")),
    ("row", regex.compile(r"[ ]{0,3}\|.*\|[ \t]*$")),
    ("item", regex.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S")),
    ("wikiitem", regex.compile(r"(?!#(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|error)\b)[*#]+[^\s*#!].*$|[*#]{2,}[ ].*$|;[ ].*$|:+[ ]\S.*$")),
    ("quote", regex.compile(r"[ ]{0,3}>[ ]?")),
)
LOG = regex.compile(r"<\d+>\d{4}-|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d+;\w+;|\w+=\S+[ \t]{2,}\w+")
JSON = regex.compile(r'[ \t]*(?:\{\s*"|\[\s*[{"]|\[\s*\[\s*[-\d"])')
CODE = regex.compile(
    r"""\#!|\#include\b|//|(?:def|class|return|import|from|export|for|if|while|print|test|awk|template|const|static_assert|assert|public|private|void|int|auto|let|var|func|fn)\b[^.]*(?:[;:{}()]|=[^=]|\$\w)[^.]*|(?!.*(?:\\[A-Za-z]+\{|&\#?\w+;|\{\{|\[\[[^\W\d]|'''))[^.!?…。？！।۔؟]*[;{}][ \t]*$|[\w.]+(?:\[\w+\])?[ \t]*(?:[|+\-*/]?=)[ \t]*\S.*|.*(?:::|->|&&|\|\||<<|==|<=)[^\s.]*.*[\w)\]};]$|"{3}.*"{3}$|if[ ].*:$|assert\b.*""",
    regex.X,
)
SENTENCE_ENDS = ".!?…。！？।۔؟"
PROSE_END = regex.compile(r"[.!?…。！？।۔؟][\"'”’»)\]]*\s*$")


BLOCK_ENDS = regex.compile(r"^(?:<[^<>]*>|\\begin\{[^{}]*\}(?:\[[^\]\n]*\])?)|(?:</[^<>]*>|\\end\{[^{}]*\})$", regex.I)
FORMULA_ENDS = regex.compile(r"^(?:<math\b[^<>]*>|\\begin\{[^{}]*\}|\$\$|\\\[|\\\(|\$)|(?:</math\s*>|\\end\{[^{}]*\}|\$\$|\\\]|\\\)|\$)$", regex.I)
INLINE_ENDS, TAG, CODE_TAG = regex.compile(r"^`+|`+$|^\\verb\*?.|</?nowiki>"), regex.compile(r"<[^<>]*>"), regex.compile(r"</?code\b[^<>]*>")
NO_TEXT = regex.compile(r"(?:category|file|image):", regex.I)
WIKI_ROW = regex.compile(r"[ \t]*(?:\{\|[^\n]*|\|\}|\|-+[^\n]*)$(*SKIP)(*FAIL)|[ \t]*(?:(?P<caption>\|\+)|\||!)[ \t]*")
WIKI_CELL = regex.compile(r"\|\||!!")
LATEX_ROW = regex.compile(r"\\\\(?:\[[^\]\n]*\])?[ \t]*")
LATEX_RULE = regex.compile(r"(?:\s|\\(?:hline|toprule|midrule|bottomrule|centering)\b|\\(?:cline|cmidrule)\{[^{}\n]*\})*")
LATEX_CELL = regex.compile(r"(?<!\\)&(?![#\w]+;)")
SPACES = regex.compile(r"\s*")
BLANK_LINES = regex.compile(r"\n{3,}")
INDENT, BULLET = regex.compile(r"(?:[ ]{4}|\t)\s*\S"), regex.compile(r"\s*[-*+]\s")
INDENTED, UNDERLINE, QUOTE = regex.compile(r"[ ]{4}|\t"), regex.compile(r"\s*(?:=+|-+)\s*"), regex.compile(r"[ ]{0,3}>[ ]?")
ITEM_MARK = regex.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?|[*#;:]+[ \t]*")
HEAD_LEAD, HEAD_TAIL, HEAD_TAG = regex.compile(r"[ \t]*[#=]+[ \t]*"), regex.compile(r"[ \t]#+[ \t]*$"), regex.compile("h[1-6]")


def line_kind(line: str) -> str:
    """The token of a line: what its beginning would be as markup, else code, log, json or text."""
    if not line.strip():
        return "blank"
    if line[0] in " \t" and INDENT.match(line):
        return "item" if LINES[7][1].match(line) and BULLET.match(line) else "indent"
    if LOG.match(line):
        return "log"
    if JSON.match(line):
        return "json"
    plain = line.lstrip()
    if not plain[0].isalpha():  # all marks that open a line are signs or digits
        for name, pattern in LINES:
            if pattern.match(line):
                return name
    if line.rstrip()[-1] in SENTENCE_ENDS:
        return "text"
    return "code" if CODE.match(line) else "text"


class Lexer:
    """The token stream of a text: opaque spans, then lines outside them, in segments that blank lines separate."""

    def __init__(self, text: str):
        self.text = text
        self.opaque: list[tuple[int, int, str]] = []
        at = 0
        while m := OPAQUE.search(text, at):
            kind = next(k for k in ("fence", "comment", "script", "pre", "math", "nowiki", "verbatim", "equation", "display", "paren", "dollar", "verb", "inline") if m[k] is not None)
            self.opaque.append((m.start(), m.end(), kind))
            at = max(m.end(), m.start() + 1)
        self.lines: list[tuple[int, int, str]] = []
        pending, at = iter([*self.opaque, (len(text) + 1, len(text) + 1, "")]), 0
        a, b, kind = next(pending)
        while at <= len(text):
            while b <= at and a <= len(text) and b < len(text) + 1:
                a, b, kind = next(pending)
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            if a <= at < b:  # inside a span that began on an earlier line or here
                stop = text.find("\n", b)
                stop = len(text) if stop < 0 else stop
                self.lines.append((at, stop, BLOCKS.get(KINDS.get(kind), "markup") if kind not in ("inline", "verb", "paren", "dollar") else self._kind(at, end)))
                end = stop if kind not in ("inline", "verb", "paren", "dollar") else end
            else:
                self.lines.append((at, end, self._kind(at, end)))
                if a < end < b:  # a span that begins within this line and goes on
                    end = text.find("\n", b)
                    end = len(text) if end < 0 else end
            at = end + 1

    def _kind(self, a: int, b: int) -> str:
        line = self.text[a:b].rstrip("\r")
        role = ROLE.match(line)
        if role and line_kind(line[role.end() :]) in ("quote", "item"):
            return "quote" if line_kind(line[role.end() :]) == "quote" else "text"
        kind = line_kind(line)
        if kind in ("text", "code") and line.lstrip()[:1] in "<\\{" and INLINE.match(line.lstrip()):
            return "markup"
        return kind

    def segments(self) -> Iterator[list[int]]:
        """Indexes of the lines between blank ones."""
        held: list[int] = []
        for k, (_, _, kind) in enumerate(self.lines):
            if kind == "blank":
                if held:
                    yield held
                held = []
            else:
                held.append(k)
        if held:
            yield held


# A wrapper is a union-free expression: a list of nodes [what, optional, repeated, support, coded], where what is a
# token or again a list of nodes. Text is a slot; its token is "text". Support counts the segments that have the node,
# coded those of them that also have lines of code or logs.


def repeats(stream: list) -> list:
    """A stream as nodes, every run of equal parts of up to four tokens being one repeated group."""
    coded = int("code" in stream or "log" in stream)
    nodes = [[t, False, False, 1, coded] for t in stream]
    for width in range(1, 5):
        out, k = [], 0
        while k < len(nodes):
            unit = _plain(nodes[k : k + width])
            end = k + width
            while len(unit) == width and _plain(nodes[end : end + width]) == unit:
                end += width
            if end > k + width and width == 1:
                out.append([nodes[k][0], False, True, 1, coded])
            elif end > k + width:
                out.append([nodes[k : k + width], False, True, 1, coded])
            else:
                out.append(nodes[k])
                end = k + 1
            k = end
        nodes = out
    return nodes


def _plain(nodes: list) -> list:
    return [n[0] if isinstance(n[0], str) else _plain(n[0]) for n in nodes]


def align(wrapper: list, nodes: list) -> list:
    """The least general union-free expression for both: what only one of them has becomes optional."""
    a, b = _plain(wrapper), _plain(nodes)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(_both(wrapper[i], nodes[j], False))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([wrapper[i][0], True, *wrapper[i][2:]])
            i += 1
        else:
            out.append([nodes[j][0], True, *nodes[j][2:]])
            j += 1
    return gathered(out)


def _both(x: list, y: list, twice: bool) -> list:
    """Two nodes of the same tokens as one; ``twice`` where they may follow each other."""
    what = align(x[0], y[0]) if isinstance(x[0], list) else x[0]
    return [what, x[1] or y[1] or twice, x[2] or y[2] or twice, x[3] + y[3], x[4] + y[4]]


def gathered(nodes: list) -> list:
    """Between two nodes that all segments have, optional nodes of the same tokens become one that repeats.

    A wrapper is so no longer than the shortest of its segments times the kinds of nodes, however many segments there
    are.
    """
    out: list = []
    here: dict[tuple, int] = {}
    for node in nodes:
        if not node[1]:
            here = {}
            out.append(node)
            continue
        key = (node[0],) if isinstance(node[0], str) else tuple(sorted(set(_tokens(node[0])))) + ("",)
        if key in here:
            out[here[key]] = _both(out[here[key]], node, True)
        else:
            here[key] = len(out)
            out.append(node)
    return out


def _tokens(nodes: list) -> Iterator[str]:
    for node in nodes:
        if isinstance(node[0], str):
            yield node[0]
        else:
            yield from _tokens(node[0])


def merge_wrappers(parts: list[tuple[int, list]]) -> tuple[int, list]:
    """One wrapper of several, each with the number of segments that it stands for, in a fixed order."""
    parts = sorted(parts, key=lambda p: (-p[0], json.dumps(p[1])))
    count, wrapper = parts[0]
    for n, nodes in parts[1:]:
        count, wrapper = count + n, align(wrapper, nodes)
    return count, wrapper


def expression(wrapper: list) -> str:
    """A wrapper as text."""
    parts = []
    for what, optional, repeated, *_ in wrapper:
        inner = ("#TEXT" if what == "text" else what) if isinstance(what, str) else f"({expression(what)})"
        parts.append(inner + ("*" if optional and repeated else "+" if repeated else "?" if optional else ""))
    return " ".join(parts)


def streams(text: str) -> Iterator[list[str]]:
    lexer = Lexer(text)
    for segment in lexer.segments():
        yield [lexer.lines[k][2] for k in segment]


#: Share of the segments with a node that must have code or log lines for the node to be no markup at its host.
CODE_SHARE = 0.3


def leaves(wrapper: list, first: int = 0) -> list[tuple[str, bool, int]]:
    """The tokens of a wrapper in order: (token, whether it is no markup there, first leaf of its repeated group)."""
    out: list[tuple[str, bool, int]] = []
    for what, _, repeated, seen, coded in wrapper:
        at = first + len(out)
        if isinstance(what, str):
            out.append((what, coded > CODE_SHARE * seen, at))
        else:
            own = leaves(what, at)
            # what the group as a whole says holds for its parts, which are aligned less often
            out += [(t, coded > CODE_SHARE * seen, at if repeated else back) for t, _, back in own]
    return out


def bind(program: list[tuple[str, bool, int]], stream: tuple[str, ...]) -> list[int]:
    """The leaf of a wrapper that parses each token of a segment; -1 for one that the wrapper doesn't have.

    From a leaf the parse goes on to the leaf of the token that follows in the same repeated group, else to one of that
    group again, else to the next behind it, else (what ``gathered`` has moved forward) to the first of all.
    """
    out, at = [], -1
    for token in stream:
        back = program[at][2] if at >= 0 else 0
        ahead = next((k for k in range(at + 1, len(program)) if program[k][0] == token), -1)
        inside = next((k for k in range(back, at + 1) if program[k][0] == token), -1) if at >= 0 else -1
        if ahead >= 0 and (inside < 0 or (ahead == at + 1 and program[ahead][2] == back)):
            at = ahead
        elif inside >= 0:
            at = inside
        else:
            found = next((k for k in range(len(program)) if program[k][0] == token), -1)
            out.append(found)
            continue
        out.append(at)
    return out


class Rules:
    """The wrappers of a host by opening token, as programs that parse its segments; without one, all is markup."""

    def __init__(self, programs: dict[str, list]):
        self.programs = {opener: [tuple(leaf) for leaf in program] for opener, program in programs.items()}
        self.known: dict[tuple[str, ...], list[bool]] = {}

    def plain(self, kinds: tuple[str, ...]) -> list[bool]:
        """For each line of a segment, whether the node that it is bound to is no markup at this host."""
        program = self.programs.get(kinds[0])
        if program is None:
            return [False] * len(kinds)
        if kinds not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[kinds] = [k >= 0 and program[k][1] for k in bind(program, kinds)]
        return self.known[kinds]


#: Noncharacters that stand for the beginning of a table row and of a cell while a text is edited.
ROW, CELL = "\ufdd0", "\ufdd1"


def _rows(text: str) -> str:
    """Rows of cells as lines, those of one table without blank lines between them."""
    out, before = [], False
    for line in text.split("\n"):
        if ROW in line:
            lead, _, row = line.partition(ROW)
            if lead.strip():
                out.append(lead.rstrip())
                before = False
            while before and not out[-1].strip():
                out.pop()
            cells = [c.strip() for c in row.replace(ROW, CELL).split(CELL)]
            cells = cells[1:] if cells and not cells[0] else cells
            if not before and out and out[-1].strip():
                out.append("")
            out.append("| " + " | ".join(cells) + " |")
            if not before:
                out.append("|" + " --- |" * len(cells))
            before = True
        else:
            before = before and not line.strip()
            out.append(line)
    return "\n".join(out)


class Document:
    """A parsed text: the elements that its markup writes and the clean text."""

    def __init__(self, text: str, rules: Rules):
        self.text, self.rules = text, rules
        self.found: set[str] = set()
        self.edits: list[tuple[int, int, str]] = []
        lexer = Lexer(text)
        for a, b, kind in lexer.opaque:
            self._span(a, b, kind)
        self.bare: list[tuple[int, int]] = []  # lines of code or logs without marks
        self.list_before = False
        for segment in lexer.segments():
            self._segment([lexer.lines[k] for k in segment])
            self.list_before = lexer.lines[segment[-1]][2] in ("item", "wikiitem")
        covered = [(a, b) for a, b, _ in lexer.opaque]
        self._inline(covered)

    def clean(self) -> str:
        """The text without markup: headings as #, items as -, table rows as cells between |, with a divider below the
        first; code fenced, formulas between $."""
        out, at = [], 0
        for a, b, new in sorted(self.edits, key=lambda e: (e[0], -e[1])):
            if a < at:
                continue
            out += [self.text[at:a], new]
            at = b
        whole = "".join([*out, self.text[at:]]).replace("\r\n", "\n")
        return BLANK_LINES.sub("\n\n", _rows(whole) if ROW in whole else whole).strip()

    def _span(self, a: int, b: int, kind: str) -> None:
        whole = self.text[a:b]
        self.found.add(KINDS.get(kind, "other"))
        if kind in ("comment", "script"):
            self.edits.append((a, b, ""))
        elif kind == "fence":
            body = whole.split("\n")[1:-1]
            self.edits.append((a, b, "```\n" + "\n".join(body) + "\n```"))
        elif kind in ("pre", "verbatim"):
            body = BLOCK_ENDS.sub("", whole)
            if kind == "pre":
                body = html.unescape(CODE_TAG.sub("", body))
            self.edits.append((a, b, "\n```\n" + body.strip("\n") + "\n```\n"))
        elif KINDS.get(kind) == "formula":
            body = FORMULA_ENDS.sub("", whole)
            self.edits.append((a, b, "$" + html.unescape(TAG.sub("", body)).strip() + "$"))
        else:
            self.edits.append((a, b, INLINE_ENDS.sub("", whole)))

    def _segment(self, lines: list[tuple[int, int, str]]) -> None:
        kinds = [k for _, _, k in lines]
        plain = self.rules.plain(tuple(kinds))
        # a beginning counts as structure where it opens the segment or follows other structure, never after prose
        if all(k in ("indent", "item") for k in kinds) and not (self.list_before and "item" in kinds) and all(INDENTED.match(self.text[a:b]) for a, b, _ in lines):
            if not plain[0]:
                self.found.add("code")
                self.edits += [(lines[0][0], lines[0][0], "```\n"), (lines[-1][1], lines[-1][1], "\n```")]
            self.bare += [(a, b) for a, b, _ in lines]
            return
        bare = ("code", "log", "json") if not any(k in ("text", "markup") for k in kinds) else ("log", "json")
        before = "blank"
        for n, (a, b, kind) in enumerate(lines):
            after = kinds[n + 1] if n + 1 < len(kinds) else "blank"
            line = self.text[a:b]
            open_ = before not in ("text", "code", "log", "json", "indent") and not plain[n]
            coded = after == "code" or before == "code"
            if kind in bare or (plain[n] and kind in ("code", "indent", "atx")):
                self.bare.append((a, b))
            elif kind == "atx" and open_ and not coded:
                level = len(line.lstrip()) - len(line.lstrip().lstrip("#"))
                many = level == 1 and (before == "atx" or after == "atx") and kinds.count("atx") > 1
                self._line("list" if many else "heading", a, b, ("- " if many else "#" * level + " ") + HEAD_TAIL.sub("", line.strip().lstrip("#")).strip(), line)
                kind = "item" if many else "atx"
            elif kind == "wikihead" and open_:
                level = len(line) - len(line.lstrip("="))
                self._line("heading", a, b, "#" * level + " " + line.strip().strip("=").strip(), line)
            elif kind in ("underline", "rule") and before == "text" and n == 1 and UNDERLINE.fullmatch(line) and open_text(lines[0], self.text):
                self._line("heading", a, b, "", line)
                self.edits.append((lines[0][0], lines[0][0], "# " if "=" in line else "## "))
            elif kind == "rule" and open_:
                self._line("other", a, b, "", line)
            elif kind in ("item", "wikiitem") and open_ and (kind == "item" or not line.startswith(":") or before == "wikiitem"):
                mark = ITEM_MARK.match(line)
                depth = (len(line) - len(line.lstrip())) // 2 if kind == "item" else len(mark[0].strip()) - 1
                self.found.add("list")
                self.edits.append((a, a + mark.end(), "  " * depth + "- "))
            elif kind == "wikitable" and (open_ or before in ("row", "wikitable")):
                self.found.add("table")
                kind = "row"
                mark = WIKI_ROW.match(line)
                if mark and mark["caption"] is None:
                    self.edits += [(a, a + mark.end(), ROW + CELL), *((a + m.start(), a + m.end(), CELL) for m in WIKI_CELL.finditer(line, mark.end()))]
                else:
                    self.edits.append((a, a + mark.end() if mark else min(b + 1, len(self.text)), ""))
            elif kind == "divider" and before == "row":
                self.found.add("table")
            elif kind == "quote" and (open_ or (before == "text" and (ROLE.match(line) or PROSE_END.search(self.text[lines[n - 1][0] : lines[n - 1][1]])))):
                role = ROLE.match(line)
                at = a + (role.end() if role else 0)
                self.found.add("other")
                self.edits.append((at, at + QUOTE.match(self.text[at:b]).end(), ""))
            before = kind

    def _line(self, element: str, a: int, b: int, new: str, line: str) -> None:
        self.found.add(element)
        if INLINE.search(line):  # inline marks of the line are edited on their own
            lead = HEAD_LEAD.match(line)
            if lead and new:
                self.edits.append((a, a + lead.end(), new[: len(new) - len(new.lstrip("#- "))]))
        else:
            self.edits.append((a, b, new))

    def _inline(self, covered: list[tuple[int, int]]) -> None:
        spans = iter([*covered, (len(self.text) + 1, len(self.text) + 1)])
        bare = iter([*sorted(self.bare), (len(self.text) + 1, len(self.text) + 1)])
        s, t = next(spans), next(bare)
        at = 0
        while m := INLINE.search(self.text, at):
            a, b = m.span()
            while s[1] <= a:
                s = next(spans)
            while t[1] <= a:
                t = next(bare)
            if s[0] <= a < s[1]:
                at = s[1]
                continue
            if a < s[0] < b and not m["template"] and not (m["command"] or m["head"] or m["link"]):
                b = min(b, b)
            inside = t[0] <= a < t[1]
            if inside and not (m["tag"] and JSON.match(self.text[t[0] : t[1]])):
                at = a + 1
                continue
            self._mark(m)
            at = m.start("ctext") if m["command"] and m.start("ctext") >= 0 and m["ctext"] else m.start("htext") if m["head"] and m["htext"] else b
            at = max(at, a + 1)

    def _tabular(self, start: int, name: str) -> None:
        """The rows and cells of a LaTeX table that begins here."""
        end = self.text.find(f"\\end{{{name}", start)
        at = start
        while 0 <= at < end:
            m = LATEX_ROW.search(self.text, at, end)
            stop = m.start() if m else end
            first = LATEX_RULE.match(self.text, at, stop).end()
            if self.text[first:stop].strip():
                self.edits.append((first, first, "\n" + ROW + CELL))
                self.edits += [(c.start(), c.end(), CELL) for c in LATEX_CELL.finditer(self.text, first, stop)]
            if m:
                self.edits.append((m.start(), m.end(), ""))
            at = m.end() if m else end

    def _mark(self, m: regex.Match) -> None:
        a, b = m.span()
        if m["tag"]:
            name = (m["name"] or "").lower()
            if self.text[max(0, a - 12) : a].lstrip().startswith("#include"):
                return
            closing = m[0].startswith("</")
            if HEAD_TAG.fullmatch(name):
                self.found.add("heading")
                self.edits.append((_before_spaces(self.text, a), b, "\n") if closing else (a, SPACES.match(self.text, b).end(), "\n\n" + "#" * int(name[1]) + " "))
            elif name in LIST_TAGS.split():
                self.found.add("list")
                opens = name in ("li", "dt", "dd") and not closing
                self.edits.append((a, SPACES.match(self.text, b).end(), "\n- ") if opens else (a, b, "\n\n" if name in ("ul", "ol", "dl") and closing else ""))
            elif name in TABLE_TAGS.split():
                self.found.add("table")
                cell = name in ("td", "th", "tr") and not closing
                self.edits.append((_before_spaces(self.text, a) if cell else a, SPACES.match(self.text, b).end() if cell else b, "\n" + ROW if name == "tr" and cell else CELL if cell else "\n\n" if name == "table" else ""))
            else:
                self.found.add({"math": "formula", "pre": "code", "syntaxhighlight": "code"}.get(name, "other"))
                self.edits.append((a, b, "\n" if name in ("br", "p", "div") else ""))
        elif m["escaped"]:
            self.found.add("other")
            self.edits.append((a, b, ""))
        elif m["entity"]:
            if m[0][1] == "#" or m[0][1:] in html5:
                self.found.add("other")
                self.edits.append((a, b, html.unescape(m[0])))
        elif m["env"]:
            name = m["ename"]
            self.found.add("list" if name in LIST_ENVIRONMENTS.split() else "table" if name in TABLE_ENVIRONMENTS.split() else "formula" if name in MATH_ENVIRONMENTS.split() else "code" if name in CODE_ENVIRONMENTS.split() else "other")
            self.edits.append((a, b, ""))
            if name in TABLE_ENVIRONMENTS.split() and name != "table" and m[0].startswith("\\begin"):
                self._tabular(b, name)
        elif m["head"]:
            self.found.add("heading")
            self.edits += [(a, m.start("htext"), "#" * (1 + HEADING_COMMANDS.split().index(m["level"].lower())) + " "), (m.end("htext"), b, "")]
        elif m["bare"] and m[0][1:] in ("hline", "toprule", "midrule", "bottomrule"):
            self.found.add("table")
            self.edits.append((a, b, ""))
        elif m["item"]:
            self.found.add("list")
            self.edits.append((a, b, "- "))
        else:
            self.found.add("other")
            group = next((g for g in ("ctext", "alt", "wtext", "wtarget", "dtext", "ltext", "rtext", "xtext", "qtext", "stext", "utext", "ktext", "etext", "itext") if m[g]), None)
            if m["command"] and m["cname"] in ("label", "cite", "ref", "citep", "citet", "vspace", "hspace", "documentclass", "usepackage"):
                group = None
            if m["wiki"] and NO_TEXT.match(m["wtarget"]):
                group = None
            if m["define"] and not m["dname"].startswith("^"):
                group = None
            self.edits += [(a, m.start(group), ""), (m.end(group), b, "")] if group else [(a, b, "")]


def _before_spaces(text: str, at: int) -> int:
    """Where the white space that ends here begins."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return at


def open_text(line: tuple[int, int, str], text: str) -> bool:
    return line[2] == "text" and not PROSE_END.search(text[line[0] : line[1]])


FORM = T.StructType([T.StructField("host", T.StringType()), T.StructField("opener", T.StringType()), T.StructField("segments", T.LongType()), T.StructField("wrapper", T.StringType())])


def _form_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct forms of a task's own segments with their counts; counts of one form may come in parts."""
    forms: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(host, stream[0], n, json.dumps(gathered(repeats(list(stream))))) for (host, stream), n in forms.items()]
        forms.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=FORM.names)

    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
            forms.update((host, tuple(stream)) for stream in streams(text))
            if len(forms) > 50_000:
                yield flush()
    if forms:
        yield flush()


def _weighted(node: list, n: int) -> list:
    what = [_weighted(x, n) for x in node[0]] if isinstance(node[0], list) else node[0]
    return [what, node[1], node[2], n * node[3], n * node[4]]


def _align_task(weigh: bool):
    """Aligns rows sorted by host, opener and salt, one group after the other, keeping one wrapper in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, count, wrapper = None, 0, []
        for batch in batches:
            for host, opener, salt, n, form in zip(*(batch.column(c).to_pylist() for c in ("host", "opener", "salt", "segments", "wrapper"))):
                nodes = json.loads(form)
                nodes = [_weighted(x, n) for x in nodes] if weigh else nodes
                if (host, opener, salt) == key:
                    count, wrapper = count + n, align(wrapper, nodes)
                    continue
                if key is not None:
                    rows.append((key[0], key[1], count, json.dumps(wrapper)))
                key, count, wrapper = (host, opener, salt), n, nodes
            if len(rows) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=FORM.names)
                rows = []
        if key is not None:
            rows.append((key[0], key[1], count, json.dumps(wrapper)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=FORM.names)

    return run


def host_of(uri: F.Column) -> F.Column:
    """The part of an address between :// and the next slash, in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


#: Parts in which the forms of one host and opener are aligned at first.
SALTS = 16


def wrappers(documents: DataFrame, text: str = "text", uri: str = "source_uri") -> DataFrame:
    """The wrappers of every host: (host, opener, segments, wrapper), one for each token that opens segments there.

    A document's token stream is cut at blank lines; runs of equal groups become one repeated group. The distinct
    forms of one host and opening token are counted and then aligned, the most frequent first: matches stay, what
    only one side has becomes optional, text is a slot. They are aligned in SALTS parts by the hash of the form and
    the parts then with each other, so a host with a third of all rows is spread, and the same documents give the
    same wrappers however they are split. A task holds one wrapper at a time.
    """
    narrow = spread(documents.select(host_of(F.col(uri)).alias("host"), F.col(text).alias("text")).where("text is not null"))
    forms = narrow.mapInArrow(_form_task, FORM).groupBy("host", "opener", "wrapper").agg(F.sum("segments").alias("segments"))
    salted = forms.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int"))
    order = [F.col("host"), F.col("opener"), F.col("salt"), F.desc("segments"), F.col("wrapper")]
    part = salted.repartition("host", "opener", "salt").sortWithinPartitions(*order).select("host", "opener", "salt", "segments", "wrapper").mapInArrow(_align_task(True), FORM)
    whole = part.withColumn("salt", F.lit(0)).repartition("host", "opener").sortWithinPartitions(*order)
    return whole.select("host", "opener", "salt", "segments", "wrapper").mapInArrow(_align_task(False), FORM)


OUT = [T.StructField("elements", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())]


def clean_markup(documents: DataFrame, doc: str = "doc_id", text: str = "text", uri: str = "source_uri", induced: DataFrame | None = None) -> DataFrame:
    """Clean text of every document and the elements its markup writes: (doc, elements, clean_text).

    ``elements`` is a sorted array of heading, list, table, code, formula and other. Headings come out as lines of
    #, items as -, table cells between |, code between ```, formulas between $; other marks are removed and their
    text is kept. What stands inside code is left as it is; program code without block marks, logs, JSON syntax,
    comparison signs, prices, paths and identifiers aren't markup. Where the beginning of a line leaves it open which
    of these it is, the segment is parsed by its host's wrapper (see ``wrappers`` and ``bind``), and the node that the
    line is bound to decides: it is no markup where this node stands among code. A null text gives a row with nulls, an empty one no
    elements; repeated rows come out as often as they stand; null addresses are one host.

    Texts are read twice and never shuffled where the wrappers are small enough for Spark to broadcast them; else
    Spark joins on the host, and its skew handling splits a large one.
    """
    kind = documents.schema[doc].dataType
    induced = induced if induced is not None else wrappers(documents, text, uri)
    # what a document needs of its host: the wrappers that have nodes which are no markup
    rules = induced.mapInArrow(_program_task, "host string, program string").groupBy("host").agg(F.concat(F.lit("{"), F.concat_ws(", ", F.array_sort(F.collect_set("program"))), F.lit("}")).alias("programs"))
    narrow = spread(documents.select(F.col(doc).alias("doc"), host_of(F.col(uri)).alias("host"), F.col(text).alias("text")))
    joined = narrow.join(rules, "host", "left").select("doc", "text", F.coalesce("programs", F.lit("{}")).alias("programs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Rules] = {}
        for batch in batches:
            elements, cleaned = [], []
            for whole, programs in zip(batch.column("text").to_pylist(), batch.column("programs").to_pylist()):
                if whole is None:
                    elements.append(None)
                    cleaned.append(None)
                    continue
                if programs not in known:
                    if len(known) > 500:
                        known.clear()
                    known[programs] = Rules(json.loads(programs))
                parsed = Document(whole, known[programs])
                elements.append(sorted(parsed.found))
                cleaned.append(parsed.clean())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(elements, pa.list_(pa.string())), pa.array(cleaned, pa.string())], names=["doc", "elements", "clean_text"])

    return joined.mapInArrow(run, T.StructType([T.StructField("doc", kind), *OUT])).withColumnRenamed("doc", doc)


def _program_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [(h, o, leaves(json.loads(w))) for h, o, w in zip(*(batch.column(c).to_pylist() for c in ("host", "opener", "wrapper")))]
        rows = [(h, f"{json.dumps(o)}: {json.dumps(p)}") for h, o, p in made if any(plain for _, plain, _ in p)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["host", "program"])
