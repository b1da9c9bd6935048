"""Leaf blocks of a page and their feature vectors."""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from functools import lru_cache

import numpy as np

PATH_DIM, WORD_DIM, SCALARS = 192, 32, 8
DIM = PATH_DIM + WORD_DIM + SCALARS

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*>")
#: What ends a tag, or opens a quoted value in it.
_STOP = re.compile(r"""=\s*["']|>""")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
#: Elements that break the text. All others are inline.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the page.
SILENT = frozenset("script style template noscript iframe object svg math textarea select title head audio video canvas".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends open elements of the value, up to the nearest container.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol dl table tbody thead tfoot div article section main body aside nav footer header form".split())
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}


def _names(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    out = []
    for _, a, b, c in _NAMES.findall(attrs):
        out += [x.lower() for x in _PIECE.findall(a or b or c)]
    return tuple(out)


class _Tags:
    """Ends of tags and comments of one page. What is known to be absent from a place on is not looked for again."""

    def __init__(self, page: str):
        self.page, self.absent = page, set()

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.absent else self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def end(self, at: int) -> int:
        """The place after the ``>`` of a tag, or -1; a quoted value may hold any other."""
        i = at
        while True:
            m = None if ">" in self.absent else _STOP.search(self.page, i)
            if m is None:
                return self.find(">", at) + 1 or -1
            if m[0] == ">":
                return m.end()
            close = self.find(m[0][-1], m.end())
            if close < 0:  # never closed: quotes do not count
                return self.find(">", at) + 1 or -1
            i = close + 1


class Block:
    __slots__ = ("text", "path", "link", "size")

    def __init__(self, text: str, path: tuple, link: int):
        self.text, self.path, self.link, self.size = text, path, link, len(text)


def blocks(page: str) -> list[Block]:
    """The text blocks in page order; ``path`` is the open elements as ``(tag, names)``."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    link = links = silent = 0

    def flush() -> None:
        nonlocal links
        if text:
            said = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if said:
                out.append(Block(said, tuple(stack), min(links, len(said))))
            text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if silent == 0 and piece:
            text.append(piece)
            if link:
                links += len(piece)

    def pop(k: int) -> None:
        nonlocal link, silent
        for tag, _ in stack[k:]:
            link -= tag == "a"
            silent -= tag in SILENT
        del stack[k:]

    at, end, tags = 0, len(page), _Tags(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0] == "<!--":
                close = tags.find("-->", at)
                at = end if close < 0 else close + 3
            continue
        close = tags.end(at)
        if close < 0:  # the page ends inside a tag
            break
        attrs, at = page[at : close - 1], close
        name = name.lower()
        if name == "br":
            add(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if not block and stack[k][0] in BLOCK:
                    break
            continue
        if block and name not in ("button", "label"):
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _CLOSES[name]:
                    pop(k)
                    if name != "tr":
                        break
                elif stack[k][0] in _HOLDS:
                    break
        if name in _VOID or attrs.endswith("/") and not block and name not in SILENT:
            continue
        if name in _RAW:
            close = _END[name].search(page, at)
            at = close.end() if close else end
            continue
        if name == "body" and silent:
            pop(0)
        stack.append((name, _names(attrs)))
        link += name == "a"
        silent += name in SILENT
    flush()
    return out


@lru_cache(20_000)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    said = [f"leaf:{next((t for t, _ in reversed(path) if t in BLOCK), '')}"]
    for tag, names in path:
        if tag in ("html", "body"):
            continue
        said.append(tag)
        said += [f".{n}" for n in names]
    for s in set(said):
        h = zlib.crc32(s.encode())
        v[h % PATH_DIM] += 1.0 if h >> 16 & 1 else -1.0
    return v


def features(found: list[Block]) -> np.ndarray:
    """One row per block: hashed tag path, hashed words, scalars."""
    x = np.zeros((len(found), DIM), np.float32)
    total = sum(b.size for b in found) or 1
    seen = 0
    for k, b in enumerate(found):
        x[k, :PATH_DIM] = _path_vector(b.path)
        words = b.text.lower().encode().split()
        hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % WORD_DIM
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(hashes, minlength=WORD_DIM) * (4 / len(words))
        stops = b.text.count(".") + b.text.count(",")
        x[k, PATH_DIM + WORD_DIM :] = (
            min(1.5, math.log1p(b.size) / 6), b.link / b.size, min(1.0, stops / len(words)), seen / total,
            b.size / total, len(b.path) / 8, k / len(found), b.text[-1] in ".!?",
        )
        seen += b.size
    return x
