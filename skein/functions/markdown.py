"""What is read of Markdown (CommonMark without extensions): a fold over lines, then one over the delimiters of each paragraph."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE, HEADING = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})"), re.compile(r" {0,3}#{1,6}(?=[ \t]|$)")
RULE, UNDERLINE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"), re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
QUOTE, ITEM = re.compile(r" {0,3}> ?"), re.compile(r"( {0,3}(?:[-+*]|\d{1,9}[.)]))(?:( {1,4})(?=\S)|( )(?= )|$)")
RAW = re.compile(r" {0,3}<(?:!--|[?!]|/?(?:address|article|aside|blockquote|body|center|details|div|dl|fieldset|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)(?=[\s/>]|$))", re.I)
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
TAG = re.compile(r"<(?:[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][\w-]*\s*)>")
AUTO, ENTITY = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>"), re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);")
TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()<\\]|\\.)(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)?(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
LABEL, ESCAPED = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]"), set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


class _Inline:
    """One paragraph: pieces of text, among them runs of delimiters that lose what pairs take of them."""

    def __init__(self, text: str, known: set[str]):
        self.out, self.runs, self.brackets, at, ticks, absent = [], [], [], 0, defaultdict(deque), set()
        for m in re.finditer("`+", text):
            ticks[len(m[0])].append(m.start())
        while at < len(text):
            c = text[at]
            if c == "\\" and text[at + 1 : at + 2] in ESCAPED and at + 1 < len(text):
                self.out.append(text[at + 1])
                at += 2
            elif c == "`":
                n = len(re.compile("`+").match(text, at)[0])
                while ticks[n] and ticks[n][0] < at + n:
                    ticks[n].popleft()
                end = ticks[n][0] if ticks[n] else None
                self.out.append("`" * n if end is None else text[at + n : end])
                at = at + n if end is None else end + n
            elif c in "*_":
                n = len(re.compile(re.escape(c) + "+").match(text, at)[0])
                self._run(text, at, n)
                at += n
            elif c == "<" and (m := AUTO.match(text, at) or TAG.match(text, at)):
                self.out.append(m[1] if m.re is AUTO else m[0])
                at = m.end()
            elif c == "<" and (end := self._other(text, at, absent)):
                self.out.append(text[at:end])
                at = end
            elif c == "&" and (m := ENTITY.match(text, at)):
                self.out.append(html.unescape(m[0]))
                at = m.end()
            elif c == "[" or text.startswith("![", at):
                mark = c if c == "[" else "!["
                self.brackets.append([len(self.out), at + len(mark), len(self.runs), mark == "![", True])
                self.out.append(mark)
                at += len(mark)
            elif c == "]":
                at = self._close(text, at, known)
            else:
                end = re.compile(r"[^\\`*_<&\[\]!]+|!").match(text, at)
                self.out.append(end[0] if end else c)
                at = end.end() if end else at + 1
        self._pair(0)

    @staticmethod
    def _other(text: str, at: int, absent: set[str]) -> int | None:
        """Where a comment, instruction or declaration ends; ``absent``: ends that do not come any more."""
        for begin, end in (("<!--", "-->"), ("<?", "?>"), ("<!", ">")):
            if text.startswith(begin, at):
                to = -1 if end in absent else text.find(end, at + len(begin))
                if to < 0:
                    absent.add(end)
                return to + len(end) if to >= 0 else None
        return None

    def _run(self, text: str, at: int, n: int) -> None:
        c, before, after = text[at], text[at - 1 : at] or " ", text[at + n : at + n + 1] or " "
        left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
        right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
        opens = left and (c == "*" or not right or _punctuation(before))
        closes = right and (c == "*" or not left or _punctuation(after))
        self.runs.append([len(self.out), c, n, opens, closes, n])
        self.out.append(c * n)

    def _close(self, text: str, at: int, known: set[str]) -> int:
        if not self.brackets:
            self.out.append("]")
            return at + 1
        place, start, runs, image, active = self.brackets.pop()
        end = None
        if active and (m := TARGET.match(text, at + 1)):
            end = m.end()
        elif active and known:
            m = LABEL.match(text, at + 1)
            own = m is None or not m[1].strip()
            label = text[start:at] if own else m[1]
            if len(label) < 1000 and _label(label) in known:
                end = m.end() if m else at + 1
        if end is None:
            self.out.append("]")
            return at + 1
        self.out[place] = ""
        self._pair(runs)
        if not image:  # no link within a link
            for b in self.brackets:
                b[4] = b[4] and b[3]
        return end

    def _pair(self, bottom: int) -> None:
        """Closers from the left, each with the nearest run before that opens; what stands between two that pair is plain. ``least``: below it no
        run opens for this kind of closer, so unmatched closers do not look at the same runs again."""
        open_runs, least = [], {}
        for run in self.runs[bottom:]:
            _, c, _, opens, closes, whole = run
            while closes and run[2]:
                kind, k = (c, opens, whole % 3), len(open_runs) - 1
                stop = least.get(kind, 0)
                while k >= stop:
                    o = open_runs[k]
                    third = (o[4] or opens) and (o[5] + whole) % 3 == 0 and (o[5] % 3 or whole % 3)
                    if o[1] == c and o[2] and not third:
                        break
                    k -= 1
                if k < stop:
                    least[kind] = len(open_runs)
                    break
                use = 2 if run[2] > 1 and open_runs[k][2] > 1 else 1
                run[2] -= use
                open_runs[k][2] -= use
                del open_runs[k + (open_runs[k][2] > 0) :]
                least = {x: min(y, len(open_runs)) for x, y in least.items()}
            if opens and run[2]:
                open_runs.append(run)
        for place, c, n, *_ in self.runs[bottom:]:
            self.out[place] = c * n
        del self.runs[bottom:]


def read_markdown(text: str | None) -> str | None:
    """The text of Markdown, white space collapsed; null: null. Marks, targets, labels, fences and their languages go; code and raw HTML stay as
    they are. Quotes and lists may be nested; lazy lines belong to their paragraph."""
    if text is None:
        return None
    parts, paragraph, known, fence, raw, widths = [], [], set(), None, False, []  # a part: text, whether to look into it

    def flush() -> None:
        joined = "\n".join(paragraph)
        while m := DEFINITION.match(joined):
            known.add(_label(m[1]))
            joined = joined[m.end() :]
        if joined.strip():
            parts.append((joined, True))
        paragraph.clear()

    for line in re.split(r"\r\n|\n|\r", text.strip()):
        line = line.expandtabs(4)
        rest, depth, marked = line, 0, False
        while depth < len(widths):  # containers that go on
            w = widths[depth]
            if w == 0 and (m := QUOTE.match(rest)):
                rest = rest[m.end() :]
            elif w and (not rest.strip() or rest.startswith(" " * w)):
                rest = rest[w:]
            else:
                break
            depth += 1
        if fence and depth < fence[2]:
            fence = None
        if raw and depth < len(widths):
            raw = False
        lazy = depth < len(widths)
        while not fence and not raw and not RULE.match(rest):  # containers that begin
            q = QUOTE.match(rest)
            i = None if q else ITEM.match(rest)
            if i and paragraph and not lazy and not marked and (not rest[i.end(1) :].strip() or (i[1].strip()[:-1] not in ("", "1"))):
                i = None  # an empty item, or a number other than 1, does not break a paragraph
            if not (q or i) or (rest.startswith("    ")):
                break
            flush()
            del widths[depth:]
            widths.append(0 if q else len(i[1]) + len(i[2] or " "))
            rest, depth, marked = rest[(q or i).end() :], depth + 1, True
        if fence:
            closing = re.match(r" {0,3}(" + re.escape(fence[0]) + r"+)[ \t]*$", rest)
            if closing and len(closing[1]) >= fence[1]:
                fence = None
            else:
                parts.append((rest, False))
        elif not rest.strip():
            flush()
            raw = False
        elif raw:
            parts.append((rest, False))
        elif paragraph and UNDERLINE.match(rest) and not (lazy and not marked):
            flush()
        elif m := FENCE.match(rest):
            flush()
            del widths[depth:]
            fence = (m[1][0], len(m[1]), depth)
        elif (m := HEADING.match(rest)) or RULE.match(rest):
            flush()
            del widths[depth:]
            if m:
                parts.append((re.sub(r"(?:^|[ \t])#+$", "", rest[m.end() :].strip()), True))
        elif RAW.match(rest):
            flush()
            del widths[depth:]
            raw = True
            parts.append((rest, False))
        elif rest.startswith("    ") and not paragraph:
            del widths[depth:]
            parts.append((rest, False))
        else:
            if not paragraph:
                del widths[depth:]
            paragraph.append(rest.strip() if not rest.endswith("\\") else rest.strip()[:-1])
    flush()
    return " ".join(" ".join("".join(_Inline(p, known).out) if look else p for p, look in parts).split())


@F.pandas_udf(T.StringType())
def _read(texts: pd.Series) -> pd.Series:
    return texts.map(read_markdown, na_action="ignore")


def markdown(text: Column) -> Column:
    """``read_markdown`` as a column, a batch of rows at a time: links and emphasis nest, which no pattern can follow."""
    return _read(text)
