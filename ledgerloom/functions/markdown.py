"""Root blocks of a CommonMark document, with exact spans, and the text of its headings.

A block parser of its own: ATX and setext headings, fenced and indented code, the seven kinds of HTML blocks, lists,
quotes, thematic breaks, link reference definitions, paragraphs.  Lines end with LF, CRLF or CR.  Offsets and columns
count UTF-16 code units.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*\Z)|~{3,})(.*)\Z")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_QUOTE = re.compile(r" {0,3}>")
_ITEM = re.compile(r"( {0,3})(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|\Z)([ \t]*)(.*)\Z")
_DEFINITION = re.compile(
    r"""[ ]{0,3}\[(?=[^\]]*[^\]\s])(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)"""
    r"""(?:[ \t]+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))|[ \t]*\n[ \t]*(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))(?=[ \t]*(?:\n|\Z)))?[ \t]*(?=\n|\Z)"""
)
#: The elements that open an HTML block of the sixth kind.
_BLOCK_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|"
    "fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|"
    "main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|"
    "title|tr|track|ul"
)
_TAG = r"""(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)"""
#: (opening, closing): a block goes on to the line that holds the closing; None: to a blank line.
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[ \t>]|\Z)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_BLOCK_TAGS})(?:[ \t]|/?>|\Z)", re.I), None),
    (re.compile(rf" {{0,3}}{_TAG}[ \t]*\Z"), None),
]


@dataclass
class Block:
    """A root block: type `heading`, `html` or `block`; kind names the block of the last."""

    type: str
    kind: str | None
    depth: int | None
    text: str | None
    value: str | None
    span: tuple[int, int, int, int, int, int]


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            return n
    return 0


def _html_kind(line: str):
    for k, (opening, closing) in enumerate(_HTML, 1):
        if opening.match(line):
            return k, closing
    return None


def _interrupts(line: str) -> bool:
    """Whether a line cannot go on a paragraph."""
    item = _ITEM.match(line)
    return (
        not line.strip() or bool(_ATX.match(line) or _FENCE.match(line) or _BREAK.match(line) or _QUOTE.match(line))
        or bool(item and item[6].strip() and (item[2] or item[3] == "1"))
        or bool((found := _html_kind(line)) and found[0] < 7)
    )


class _Lines:
    def __init__(self, content: str):
        self.text, self.at, offset = [], [], 0
        for m in re.finditer(r"([^\r\n]*)(\r\n|\r|\n|\Z)", content):
            if m.start() == len(content) and (not m[0] and self.text or not content):
                break
            self.text.append(m[1])
            self.at.append(offset)
            offset += _units(m[0])

    def span(self, first: int, last: int, skip_indent: bool = True) -> tuple[int, int, int, int, int, int]:
        lead = len(self.text[first]) - len(self.text[first].lstrip(" \t")) if skip_indent else 0
        end = _units(self.text[last])
        return first + 1, lead + 1, self.at[first] + lead, last + 1, end + 1, self.at[last] + end


def _list_end(lines: list[str], i: int) -> int:
    """The last line of the list that starts at line i."""
    first = _ITEM.match(lines[i])
    marker, last, paragraph = first[2] or first[4], i, True
    width = len(first[1]) + len(first[2] or first[3] + first[4]) + (len(first[5]) if 1 <= len(first[5]) <= 4 and first[6] else 1)
    j, blank = i + 1, False
    while j < len(lines):
        line = lines[j]
        if not line.strip():
            blank = True
            j += 1
            continue
        item = _ITEM.match(line)
        if _indent(line) >= width:
            paragraph = True
        elif item and (item[2] or item[4]) == marker and not _BREAK.match(line):
            width = len(item[1]) + len(item[2] or item[3] + item[4]) + (len(item[5]) if 1 <= len(item[5]) <= 4 and item[6] else 1)
            paragraph = bool(item[6].strip())
        elif blank or _interrupts(line) or not paragraph:
            break
        last, blank = j, False
        j += 1
    return last


def parse_blocks(content: str) -> list[Block]:
    """The root blocks of a document in order."""
    rows = _Lines(content)
    lines, out, i = rows.text, [], 0

    def block(kind: str, last: int, skip_indent: bool = True) -> None:
        out.append(Block("block", kind, None, None, None, rows.span(i, last, skip_indent)))

    while i < len(lines):
        line = lines[i]
        if not line.strip(" \t"):
            i += 1
            continue
        last = i
        if _indent(line) >= 4:
            j = i
            while j < len(lines) and (_indent(lines[j]) >= 4 or not lines[j].strip(" \t")):
                last = j if lines[j].strip(" \t") else last
                j += 1
            block("code", last, False)
        elif m := _ATX.match(line):
            out.append(Block("heading", None, len(m[1]), inline_text("" if re.fullmatch("#+", m[2] or "") else m[2] or ""), None, rows.span(i, i)))
        elif m := _FENCE.match(line):
            closing = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*\Z")
            last = next((j for j in range(i + 1, len(lines)) if closing.match(lines[j])), len(lines) - 1)
            block("code", last)
        elif _BREAK.match(line):
            block("thematic-break", i)
        elif found := _html_kind(line):
            if found[1] is not None:
                last = next((j for j in range(i, len(lines)) if found[1].search(lines[j])), len(lines) - 1)
            else:
                while last + 1 < len(lines) and lines[last + 1].strip(" \t"):
                    last += 1
            out.append(Block("html", None, None, None, "\n".join(lines[i : last + 1]), rows.span(i, last, False)))
        elif _QUOTE.match(line):
            while last + 1 < len(lines) and (_QUOTE.match(lines[last + 1]) or not (_interrupts(lines[last + 1]) or _QUOTE.sub("", lines[last]).strip() == "")):
                last += 1
            block("blockquote", last)
        elif _ITEM.match(line):
            last = _list_end(lines, i)
            block("list", last)
        else:
            depth = None
            while last + 1 < len(lines):
                if m := _SETEXT.match(lines[last + 1]):
                    depth = 1 if m[1][0] == "=" else 2
                    break
                if _interrupts(lines[last + 1]):
                    break
                last += 1
            # Definitions may stand at the head of a paragraph.
            while i <= last and (m := _DEFINITION.match("\n".join(lines[i : last + 1]))):
                end = i + m[0].count("\n")
                block("definition", end)
                i = end + 1
            if i <= last:
                if depth:
                    text = inline_text("\n".join(x.strip(" \t") for x in lines[i : last + 1]))
                    out.append(Block("heading", None, depth, text, None, rows.span(i, last + 1)))
                    last += 1
                else:
                    block("paragraph", last)
        i = max(i, last + 1)
    return out


# ---- inline text ------------------------------------------------------------------------------------------------

_CODE = re.compile(r"(`+)(?!`)(.*?[^`])\1(?!`)", re.S)
_IMAGE = re.compile(r"!\[(?:[^\[\]\\]|\\.)*\](?:\((?:[^()\\]|\\.|\([^()]*\))*\)|\[[^\]]*\])?")
_LINK = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]\((?:[^()\\]|\\.|\([^()]*\))*\)")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9.-]+)>")
_EMPHASIS = re.compile(r"(\*{1,3}|(?<!\w)_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)|(\*{1,3})(?=\S)(.+?)(?<=\S)\3", re.S)


def inline_text(source: str) -> str:
    """The text and inline code of a heading; images and inline HTML give none."""
    held: list[str] = []

    def hold(text: str) -> str:
        held.append(text)
        return f"\x00{len(held) - 1}\x00"

    def code(m: re.Match) -> str:
        body = m[2].replace("\n", " ")
        return hold(body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body)

    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m[1]) if m[1] != "`" else m[0], source.strip(" \t"))
    text = _CODE.sub(code, text)
    text = _AUTO.sub(lambda m: hold(m[1]), text)
    text = re.sub(rf"{_TAG}|<!--.*?-->", "", text, flags=re.S)
    text = _IMAGE.sub("", text)
    text = _LINK.sub(r"\1", text)
    before = None
    while before != text:
        before = text
        text = _EMPHASIS.sub(lambda m: m[2] or m[4] or "", text)
    text = html.unescape(text).replace("\\`", "`")
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)
