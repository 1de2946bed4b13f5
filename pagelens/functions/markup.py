"""HTML markup as events, from text that comes in pieces; time is linear in the text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5

# a quote that is opened and not closed matches nothing, so that the tag waits for the rest
_ATTRIBUTE = r"""[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^\s"']))"""
_TAG = re.compile(rf"</?([a-zA-Z][^\s/>]*+)((?:{_ATTRIBUTE})*+)>")
_PAIR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+(=)\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_COMMENT, _CDATA = re.compile(r"--!?>"), "<![CDATA["
_ENTITY = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")

# Elements without an end, elements whose content is text, and elements that an opening tag ends.
VOID = frozenset("area base basefont br col command embed frame hr img input isindex keygen link meta param source track wbr".split())
RAW: dict[str, re.Pattern[str]] = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>", re.I) for n in ("script", "style", "title", "textarea", "xmp", "noembed", "noframes")}
_ENDS = {"body": {"head", "link", "script"}, "li": {"li"}, "option": {"option"}, "optgroup": {"optgroup", "option"}, "dd": {"dt", "dd"}, "dt": {"dt", "dd"}, "tr": {"tr", "th", "td"}, "td": {"thead", "th", "td"}, "th": {"th"}}
_ENDS |= {n: {"p"} for n in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_FOREIGN = ("svg", "math")
_BEGUN = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in RAW}


def closed_text(value: str) -> str:
    """A text with those of its entities that end with their semicolon; all others stay as they are written."""

    def one(m: re.Match[str]) -> str:
        name = m[1]
        return html.unescape("&" + name) + m[2] if name.endswith(";") and (name.startswith("#") or name in html5) else m[0]

    return _ENTITY.sub(one, value) if "&" in value else value


def attribute_text(value: str) -> str:
    """An attribute's value with its entities; without a semicolon a name before '=' or more letters is none."""

    def one(m: re.Match[str]) -> str:
        name = m[1]
        if name.startswith("#") or name.endswith(";") or (name in html5 and not m[2]):
            return html.unescape("&" + name) + m[2]
        return m[0]

    return _ENTITY.sub(one, value) if "&" in value else value


class Tokens:
    """Events ("open", name, attributes), ("close", name, whether it was written) and ("text", "", text) of pieces of HTML.

    An end tag ends what was opened since its start; without a start it is nothing. What is left incomplete waits for the
    next piece. With `closed`, entities without their semicolon are none; HTML has some of these too.
    """

    def __init__(self, rest: str = "", raw: str = "", stack: list[str] | None = None, decode: bool = True, closed: bool = False):
        self.rest, self.raw, self.stack, self.decode, self.closed = rest, raw, stack or [], decode, closed
        self.open = Counter(self.stack)

    def state(self) -> dict:
        return {"rest": self.rest, "raw": self.raw, "stack": self.stack, "closed": self.closed}

    def _text(self, value: str, plain: bool = False) -> Iterator[tuple]:
        if value:
            shown = closed_text if self.closed else html.unescape
            yield "text", "", shown(value) if self.decode and not plain and "&" in value else value

    def _pop(self, name: str, written: bool) -> Iterator[tuple]:
        while self.stack:
            top = self.stack.pop()
            self.open[top] -= 1
            yield "close", top, written and top == name
            if top == name:
                break

    def _attributes(self, text: str) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in _PAIR.finditer(text):
            value = m[3] if m[3] is not None else m[4] if m[4] is not None else m[5] or ""
            shown = closed_text if self.closed else attribute_text
            found.setdefault(m[1].lower(), shown(value) if self.decode else value)
        return found

    def _tag(self, m: re.Match[str]) -> Iterator[tuple]:
        name = m[1].lower()
        if m[0][1] == "/":
            if self.open[name]:
                yield from self._pop(name, True)
            return
        while self.stack and self.stack[-1] in _ENDS.get(name, ()):
            yield from self._pop(self.stack[-1], False)
        yield "open", name, self._attributes(m[2])
        if name in VOID:
            yield "close", name, False
            return
        self.stack.append(name)
        self.open[name] += 1
        closed = m[2].endswith("/")
        if closed and any(self.open[f] for f in _FOREIGN):
            yield from self._pop(name, True)
        elif name in RAW and not closed and not any(self.open[f] for f in _FOREIGN):
            self.raw = name

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple]:
        text, at = self.rest + piece, 0
        # an unfinished tag is looked at again only when something that may finish it has come
        if not last and ">" not in piece and self.rest[:1] == "<" and (self.raw or self.rest[1:2] in ("!", "?") or _opens(self.rest)) and len(self.rest) > 12:
            self.rest = text
            return
        while at < len(text):
            if self.raw:
                m = RAW[self.raw].search(text, at)
                end = m.start() if m else len(text) if last else _held(text, at, self.raw)
                yield from self._text(text[at:end], plain=self.raw not in ("title", "textarea"))
                at = end
                if not m:
                    break
                name, self.raw, at = self.raw, "", m.end()
                yield from self._pop(name, True)
                continue
            start = text.find("<", at)
            end = len(text) if start < 0 else start
            if start < 0 and not last and (cut := text.rfind("&", max(at, end - 40), end)) >= 0 and ";" not in text[cut:end]:
                end = cut
            yield from self._text(text[at:end])
            at = end
            if start < 0:
                break
            if text.startswith("<!--", at):
                m = _COMMENT.search(text, at + (2 if text.startswith("<!-->", at) else 4))
                if not m:
                    at = len(text) if last else at
                    break
                at = m.end()
            elif text.startswith(_CDATA, at):
                end = text.find("]]>", at)
                if end < 0:
                    at = len(text) if last else at
                    break
                yield from self._text(text[at + len(_CDATA) : end], plain=True)
                at = end + 3
            elif text[at + 1 : at + 2] in ("!", "?") or (text.startswith("</", at) and not text[at + 2 : at + 3].isalpha() and len(text) > at + 2):
                if not last and len(text) < at + len(_CDATA) and (_CDATA.startswith(text[at:]) or "<!--".startswith(text[at:])):
                    break
                end = text.find(">", at)
                if end < 0:
                    at = len(text) if last else at
                    break
                at = end + 1
            elif m := _TAG.match(text, at):
                at = m.end()
                yield from self._tag(m)
            elif _opens(text, at):
                # a tag without its end: dropped at the end of the document
                at = len(text) if last else at
                break
            elif len(text) == at + 1 and not last:
                break
            else:
                yield from self._text("<")
                at += 1
        self.rest = text[at:]
        if last:
            while self.stack:
                yield from self._pop(self.stack[-1], False)


def _opens(text: str, at: int = 0) -> bool:
    """Whether a tag begins here, or may once more has come."""
    return text[at + 1 : at + 2].isalpha() or (text.startswith("</", at) and (text[at + 2 : at + 3].isalpha() or len(text) == at + 2))


def _held(text: str, at: int, name: str) -> int:
    """Where the end of the text begins that may be an end tag, or an entity, that is not complete."""
    begun = _BEGUN[name].search(text, at)
    if begun:
        return begun.start()
    cut = text.rfind("<", max(at, len(text) - len(name) - 2))
    if cut < 0 and (amp := text.rfind("&", max(at, len(text) - 40))) >= 0 and ";" not in text[amp:]:
        cut = amp
    return cut if cut >= 0 else len(text)
