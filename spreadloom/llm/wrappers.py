"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tokens: tags (with the first word of their class) and stretches of text. Within a page, runs of
like segments fold into a repeated group. Pages of a host are aligned one after another; what only some have becomes an
optional group, differing texts become a slot, and a text that several pages repeat is the host's template. The wrapper
that comes out is a regular expression over tokens; the part that holds its slots is the article.
"""

from __future__ import annotations

import hashlib
import heapq
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadloom.llm.store import small_side, stored

#: Elements that are never part of an article, elements that break lines, and elements without an end.
SKIPPED = frozenset("head nav aside footer form script style noscript template iframe object svg canvas button select option textarea input dialog menu video audio map title".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that words of a class, id or role can mark as a whole; on headings, paragraphs and parts of a line they say nothing.
CONTAINERS = frozenset("article aside center dd details div dl fieldset figure footer form header li main nav ol section table tbody td tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is not the article (menus, notices, adverts, sharing, readers' comments).
ASIDE = re.compile(r"^(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav(?!y)\w*|menu\w*|sidebar\w*|footer|masthead|site-?header|page-?header|breadcrumbs?|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comments?|comment-\w+|disqus|respond|reply|replies|pagination|pager|skip|toolbar|widget|complementary|contentinfo|navigation)$", re.I)
#: The same for one part of a word with hyphens, and for pages of which nothing tells where the article stands.
ASIDE_PART = re.compile(r"^(?:nav|navbar|menu|sidebar|footer|masthead|cookies?|consent|ads|advert|banner|breadcrumbs?|newsletter)$", re.I)
HEADER = re.compile(r"^(?:header|top-?bar|logo|site-?(?:title|name|branding))$", re.I)
#: Words of a class or id that mark the article.
ARTICLE = re.compile(r"^(?:article|post|entry|story|main|content|article-?body|post-?body|post-?content|entry-?content|main-?content|story-?body)$", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.I | re.S)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BARE = re.compile(r"^[^\"'=]*=[^\"']*$")  # an attribute with a value without quotes, to which a slash at its end belongs
#: Cells of the table of a full alignment (longer ones are cut at tokens that either side has once), and elements that a
#: wrapper of whole pages has at most, or a quarter more than the largest page. Hosts that need more have wrappers of
#: shallow pages, all of them in each.
CELLS, MOST_ELEMENTS = 160_000, 4000
#: How deep elements count in those; what stands deeper is one text. 0 stands for whole pages, a depth below 0 for tags
#: without their classes, which hosts have too that reach less than ENOUGH_DEEP with classes.
DEPTHS, ENOUGH_DEEP = (12, 8, 6, 4, 3, 2, 1), 4
#: Different pages that must have an equal text before it counts as template, and elements that can hold an article.
REPEATED = 3
HOLDERS = frozenset("article body center div main section table td".split())
#: Share of a host's differing text, links apart, that the element of the article must hold, and share of tags that
#: neighbouring holders must have in common to count as one repeated group.
ENOUGH, ALIKE = 0.9, 0.5
#: Stands for a token that a wrapper does not know; no pattern contains it.
UNKNOWN = "\uf8ff"
#: Hosts that a task holds before it hands its wrappers on, and in how many parts a host's are merged first.
HOSTS, PARTS = 2000, 256


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(token, marks, text) of a page; the token is ``<tag.class``, ``/tag`` or ``#`` for text."""
    out, at = [], 0
    last = page.rfind(">") + 1  # no tag ends beyond it, so none is looked for there
    for m in _TOKEN.finditer(page, 0, last):
        if m.start() > at and (text := page[at : m.start()]).strip(" \t\r\n\f\v"):
            out.append(("#", "", text))
        elif m.start() > at and out:
            out.append((" ", "", " "))
        at = m.end()
        if at == last and (m[1] and not m[0].rstrip(" \t\r\n\f\v>").lower().endswith("</" + m[1].lower()) or m[0].startswith("<!--") and not m[0].endswith("-->")):
            return out  # a comment or script that does not end takes the rest
        if m[3]:
            name = m[3].lower()
            if m[2]:
                out.append(("/" + name, "", ""))
            else:
                marks = " ".join(a or b or c for a, b, c in _MARK.findall(m[4]))
                out.append((f"<{name}.{marks.split()[0].lower() if marks else ''}", marks, ""))
                if m[4].rstrip().endswith("/") and name not in VOID and not _BARE.search(m[4].split()[-1]):
                    out.append(("/" + name, "", ""))
    if (text := page[at:].partition("<!--")[0]).strip(" \t\r\n\f\v"):
        out.append(("#", "", text))
    return out


def _name(token: str) -> str:
    return token[1:].partition(".")[0]


# ---- inference ------------------------------------------------------------------------------------------------------
# An element of a wrapper is [kind, value, optional]: a tag ("t"), a text ("#") or a repeated group ("+", whose value is a
# list of elements). Neighbours with the same optional number above 0 come and go together. Texts and groups outside of
# groups go on with what was read there: the hash of the text while all pages agree ("" once they differ, a slot), marks
# of up to REPEATED different pages that had it, and the length of the texts.
def valued(found: list[tuple[str, str, str]]) -> list[str]:
    """The tokens of a page as inference reads them: a text is ``#``, the hash of its words, ``.`` and its length."""
    out = []
    for token, _, text in found:
        if token == "#":
            words = " ".join(text.split())
            out.append(f"#{hashlib.blake2b(words.encode('utf-8', 'replace'), digest_size=6).hexdigest()}.{len(words)}")
        elif token != " ":
            out.append(token)
    return out


def _plain(stream: list[str]) -> list[str]:
    return ["#" if t[0] == "#" else t for t in stream]


def _mark(stream: list[str]) -> str:
    """What tells a page from others with different texts."""
    return hashlib.blake2b(" ".join(t for t in stream if t[0] == "#").encode(), digest_size=4).hexdigest()


def _told(part: list[str]) -> tuple[str, int]:
    """(hash, length) of the texts of a part of a stream; the hash is "" where a text has none."""
    texts = [t[1:].partition(".") for t in part if t[0] == "#"]
    if not all(x for x, _, _ in texts):
        return "", 0
    own = texts[0][0] if len(texts) == 1 else hashlib.blake2b(" ".join(x for x, _, _ in texts).encode(), digest_size=6).hexdigest()
    return own, sum(int(n) for _, _, n in texts)


def _read_too(e: list, own: str, marks: list[str], length: int) -> list:
    """What was read at ``e`` together with what was read there on other pages."""
    return [own if own == e[3] else "", sorted({*e[4], *marks})[:REPEATED], e[5] + length]


def _open_ends(stream: list[str]) -> list[int]:
    """For each place, where the first end tag from there on stands whose start does not, or the length."""
    n = len(stream)
    out, ends, ahead, gone = [n] * n, {}, [], set()
    for k in range(n - 1, -1, -1):  # a start takes the nearest end of its name, for all places before it as well
        t = stream[k]
        if t[0] == "/":
            ends.setdefault(t[1:], []).append(k)
            heapq.heappush(ahead, k)
        elif t[0] == "<" and (own := ends.get(_name(t))):
            gone.add(own.pop())
        while ahead and ahead[0] in gone:
            gone.discard(heapq.heappop(ahead))
        out[k] = ahead[0] if ahead else n
    return out


def _alike(head: str, one: list[str], other: list[str]) -> bool:
    """Whether segments that start with the same tag repeat each other; holders must be made of the same tags mostly."""
    x, y = set(one), set(other)
    return _name(head) not in HOLDERS or len(x & y) >= ALIKE * len(x | y)


def fold(stream: list[str], heads: frozenset = frozenset()) -> list[list]:
    """Elements of a page: successive segments that start with the same tag become one repeated group."""
    read, stream, mark = stream, _plain(stream), _mark(stream)
    heads = frozenset(t for t in heads if _name(t) not in HOLDERS)  # neither their number nor their name makes them alike
    out, i, n = [], 0, len(stream)
    again, seen = [n] * n, {}  # where each token comes next
    for k in range(n - 1, -1, -1):
        again[k] = seen.get(stream[k], n)
        seen[stream[k]] = k

    ends = _open_ends(stream)

    def told(a: int, z: int) -> list:
        own, length = _told(read[a:z])
        return [own, [mark], length]

    while i < n:
        t = stream[i]
        if t == "#" or t[0] == "/":
            out.append(["#", t, 0, *told(i, i + 1)] if t == "#" else ["t", t, 0])
            i += 1
            continue
        segments, a, known = [], i, set()
        while a < n and stream[a] == t:
            z = again[a]
            own = min(ends[a], z)
            if not segments and (own < z or z == n) and t not in heads:
                break  # it stands alone
            if own < z or z == n:  # the last one ends where another element does
                while segments and own > a + 1 and stream[own - 1] not in known and stream[own - 1] != "#":
                    own -= 1
                if segments and not _alike(t, segments[0], stream[a:own]):
                    break
                segments.append(stream[a:own])
                a = own
                break
            if segments and not _alike(t, segments[0], stream[a:z]):
                break
            segments.append(stream[a:z])
            known.update(stream[a:z])
            a = z
        if (len(segments) > 1 or t in heads) and a > i and _name(t) not in ("html", "head", "body"):
            body = None
            for s in dict.fromkeys(map(tuple, segments)):
                part = [["#" if x == "#" else "t", x, 0] for x in s]
                body = part if body is None else align(body, part)
            out.append(["+", body, 0, *told(i, a)])
            i = a
        else:
            out.append(["t", t, 0])
            i += 1
    return out


def _key(e: list) -> str:
    return "+" + e[1][0][1] if e[0] == "+" else e[1]


def _both(x: list, y: list, optional: int) -> list:
    """One element for two that are aligned."""
    body = align(x[1], y[1]) if x[0] == "+" and x[1] != y[1] else x[1]
    return [x[0], body, optional, *(_read_too(x, *y[3:]) if len(x) > 3 and len(y) > 3 else x[3:])]


def _common(ka: list[str], kb: list[str], i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """Pairs of places of a common subsequence of ka[i:n] and kb[j:m], in order.

    It is a longest one where the table fits in CELLS. Longer stretches are cut at tokens that both sides have just once,
    as far as those come in the same order; what has none is left out, so it becomes optional on either side.
    """
    if (n - i) * (m - j) <= CELLS:
        best = [[0] * (m - j + 1) for _ in range(n - i + 1)]
        for x in range(n - i - 1, -1, -1):
            row, below = best[x], best[x + 1]
            for y in range(m - j - 1, -1, -1):
                row[y] = below[y + 1] + 1 if ka[i + x] == kb[j + y] else max(below[y], row[y + 1])
        out, x, y = [], 0, 0
        while x < n - i and y < m - j:
            if ka[i + x] == kb[j + y]:
                out.append((i + x, j + y))
                x, y = x + 1, y + 1
            elif best[x + 1][y] >= best[x][y + 1]:
                x += 1
            else:
                y += 1
        return out
    out, tail = [], []
    while i < n and j < m and ka[i] == kb[j]:
        out.append((i, j))
        i, j = i + 1, j + 1
    while i < n and j < m and ka[n - 1] == kb[m - 1]:
        n, m = n - 1, m - 1
        tail.append((n, m))
    once = [Counter(ka[i:n]), Counter(kb[j:m])]
    where = {kb[y]: y for y in range(j, m)}
    cuts = [(x, where[ka[x]]) for x in range(i, n) if once[0][ka[x]] == 1 and once[1][ka[x]] == 1]
    tops: list[tuple[int, int]] = []  # the end of the best increasing run of each length, and its place in cuts
    back = []
    for k, (_, y) in enumerate(cuts):
        p = bisect_left(tops, (y, -1))
        back.append(tops[p - 1][1] if p else -1)
        tops[p : p + 1] = [(y, k)]
    chosen, k = [], tops[-1][1] if tops else -1
    while k >= 0:
        chosen.append(cuts[k])
        k = back[k]
    for x, y in [*reversed(chosen), *([(n, m)] if chosen or (n - i) * (m - j) <= CELLS else [])]:
        out += _common(ka, kb, i, x, j, y)
        if (x, y) != (n, m):
            out.append((x, y))
            i, j = x + 1, y + 1
    return out + tail[::-1]


def align(a: list[list], b: list[list]) -> list[list]:
    """The least wrapper that covers both: a longest common subsequence stays, the rest becomes optional."""
    ka, kb = [_key(e) for e in a], [_key(e) for e in b]
    if ka == kb and [e[2] for e in a] == [e[2] for e in b]:
        return [_both(x, y, x[2]) for x, y in zip(a, b, strict=True)]
    n, m, pairs = len(a), len(b), dict(_common(ka, kb, 0, len(a), 0, len(b)))
    out, groups, i, j, run = [], {}, 0, 0, 0
    number = lambda key: 0 if key is None else groups.setdefault(key, len(groups) + 1)
    put = lambda e, key: out.append([e[0], e[1], number(key), *e[3:]])
    while i < n or j < m:
        if i < n and pairs.get(i) == j:
            out.append(_both(a[i], b[j], number((a[i][2], b[j][2], 0, run) if a[i][2] or b[j][2] else None)))
            i, j = i + 1, j + 1
            run += 0 if a[i - 1][2] or b[j - 1][2] else 1
        elif i < n and i not in pairs:
            put(a[i], (a[i][2], 0, 1, run))
            i += 1
        else:
            put(b[j], (0, b[j][2], 2, run))
            j += 1
    return out


def _closed(stream: list[str]) -> dict[int, int]:
    """Where the elements that end do so, by the place of their start."""
    starts: dict[str, list[int]] = {}
    ends = {}
    for k, t in enumerate(stream):
        if t[0] == "<":
            starts.setdefault(_name(t), []).append(k)
        elif t[0] == "/" and starts.get(t[1:]):
            ends[starts[t[1:]].pop()] = k
    return ends


@lru_cache(1 << 14)
def _general(token: str, classes: bool) -> str:
    """A tag with 0 for each part of its class that has a digit, or with no more than what its class says of the article."""
    if token[0] != "<":
        return token
    mark = token.partition(".")[2]
    kind = "sidebar" if _marks_aside(mark) else "article" if ARTICLE.match(mark) else ""
    return f"<{_name(token)}.{kind or classes * re.sub('[^-_]*[0-9][^-_]*', '0', mark)}"


def nested(stream: list[str]) -> tuple[list[int], list[str], list[int], list[int]]:
    """What ``shallow`` reads: how deep each token stands, the hashes of texts, and before each token, the number of texts
    and their length outside of links."""
    deep, link = [0] * (len(stream) + 1), [0] * (len(stream) + 1)
    for a, e in _closed(stream).items():
        for step in (deep, link) if _name(stream[a]) == "a" else (deep,):
            step[a + 1] += 1
            step[e] -= 1
    told = [t[1:].split(".") if t[0] == "#" else None for t in stream]
    count = [0, *accumulate(x is not None for x in told)]
    length = [0, *accumulate(int(x[1]) if x and not inside else 0 for x, inside in zip(told, accumulate(link[:-1]), strict=True))]
    return list(accumulate(deep)), [x[0] for x in told if x], count, length


def shallow(stream: list[str], depth: int, read: tuple | None = None) -> tuple[list[str], list[int]]:
    """A stream with what stands ``depth`` elements deep as one text, and where each of its tokens starts (and the end).

    Such a text is as long as its texts outside of links. Classes count without digits, or not at all below 0. ``read`` is
    what ``nested`` gives for the stream.
    """
    classes, depth = depth > 0, abs(depth)
    deep, hashes, count, length = read or nested(stream)
    out, places, k = [], [], 0
    while k < len(stream):
        z = k + 1
        if deep[k] < depth:
            out.append(_general(stream[k], classes))
            places.append(k)
        else:
            while z < len(stream) and deep[z] >= depth:
                z += 1
            if own := hashes[count[k] : count[z]]:
                own = own[0] if len(own) == 1 else hashlib.blake2b(" ".join(own).encode(), digest_size=6).hexdigest()
                out.append(f"#{own}.{length[z] - length[k]}")
                places.append(k)
        k = z
    return out, [*places, len(stream)]


def main_span(stream: list[str], lengths: list[int]) -> tuple[int, int] | None:
    """Where tags say the article stands: inside ``article``, else ``main``, else an element marked as one; of several,
    the one with the longest text (``lengths`` by token), and of those the first."""
    ends, before = _closed(stream), [0, *accumulate(lengths)]
    for wanted in (lambda t: _name(t) == "article", lambda t: _name(t) == "main", lambda t: bool(ARTICLE.match(t.partition(".")[2]))):
        spans = [(a + 1, ends.get(a, len(stream))) for a, t in enumerate(stream) if t[0] == "<" and wanted(t)]
        if spans:
            return max(spans, key=lambda s: before[s[1]] - before[s[0]])
    return None


def _marks_aside(mark: str) -> bool:
    return bool(ASIDE.match(mark)) or any(ASIDE_PART.match(x) for x in re.split("[-_]", mark))


def _aside(token: str) -> bool:
    return token[0] == "<" and _name(token) not in VOID and (_name(token) in SKIPPED or _name(token) in CONTAINERS and _marks_aside(token.partition(".")[2]))


def is_template(e: list) -> bool:
    return len(e) > 3 and bool(e[3]) and len(e[4]) >= REPEATED


def _links(body: list[list]) -> tuple[int, int]:
    """(texts inside links, other texts) of the elements of a group."""
    ends, inside, out = _closed(["#" if e[0] == "+" else e[1] for e in body]), -1, [0, 0]
    for k, e in enumerate(body):
        if e[0] == "t" and _name(e[1]) == "a" and k in ends:
            inside = max(inside, ends[k])
        found = (1, 0) if e[0] == "#" and k < inside else (0, 1) if e[0] == "#" else _links(e[1]) if e[0] == "+" else (0, 0)
        if k < inside:
            found = (sum(found), 0)
        out = [out[0] + found[0], out[1] + found[1]]
    return out[0], out[1]


def article_span(elements: list[list]) -> tuple[int, int, bool] | None:
    """(first element, the one after the last, whether tags mark it) of the article of a wrapper.

    Texts that are not template and not in an element that is never the article's are the article's. A marked element
    is the article if it holds half of their length. Else it is all children, from the first with such a text to the
    last one, of the smallest element that holds nearly all (``ENOUGH``) of them over the host's pages, texts of links
    and groups of mostly links apart: menus, adverts and notices may differ from page to page, but say little. Where no
    text differs among pages, tags alone tell.
    """
    stream = ["#" if e[0] == "#" else e[1][0][1] if e[0] == "+" else e[1] for e in elements]
    tags = ["+" if e[0] == "+" else t for e, t in zip(elements, stream, strict=True)]
    pairs, out, link = _closed(tags), 0, 0
    own: list[int] = []
    weight = [0] * len(tags)
    for k, t in enumerate(tags):
        if t[0] == "<" and _name(t) == "a" and k in pairs:
            link = max(link, pairs[k])
        if k < out:
            continue
        if _aside(t) and k in pairs:
            out = pairs[k]
        elif t in "#+" and len(elements[k]) > 3 and not is_template(elements[k]) and not _aside(stream[k]):
            own.append(k)
            if k >= link:
                inside, other = _links(elements[k][1]) if t == "+" else (0, 1)
                weight[k] = 0 if inside > other else elements[k][5]
    marked = main_span(tags, [e[5] if len(e) > 3 else 0 for e in elements])
    if not any(not elements[k][3] for k in own):
        return (*marked, True) if marked else None
    length = sum(elements[k][5] for k in own)
    if marked and 2 * sum(elements[k][5] for k in own if marked[0] <= k < marked[1]) >= length:
        return (*marked, True)
    if not any(weight):
        held = set(own)
        weight = [elements[k][5] if k in held else 0 for k in range(len(tags))]
    before = [0, *accumulate(weight)]
    a, z = max(((i, e) for i, e in pairs.items() if before[-1] and _name(tags[i]) in HOLDERS and before[e] - before[i] >= ENOUGH * before[-1]), default=(-1, len(tags)))
    if a < 0 or _name(tags[a]) == "body":  # links at either end of a page are menus, those of an element its own
        own = [k for k in own if weight[k]] or own
    own = [k for k in own if a < k < z]
    lo, hi = own[0], own[-1]
    for i, e in sorted(pairs.items()):
        if a < i and e < z:
            lo = i if i < lo <= e else lo
            hi = e if i <= hi < e else hi
    return lo, hi + 1, False


class Wrapper:
    """A compiled wrapper: elements, and a regular expression over one character a token.

    ``depth`` tells the streams that it matches (see ``shallow``), ``most`` the elements of the largest page in it.
    """

    def __init__(self, elements: list[list], main: list | tuple | None = None, depth: int = 0, most: int = 0):
        self.elements, self.depth, self.most = elements, depth, most
        self.chars: dict[str, str] = {}
        self.texts: list[int] = []
        self.main = main or article_span(elements)
        self.pattern = re.compile(self._pattern(elements, True))

    def _char(self, token: str) -> str:
        return self.chars.setdefault(token, chr(0xF0000 + len(self.chars)))

    def _pattern(self, elements: list[list], top: bool = False) -> str:
        first, after = self.main[:2] if top and self.main else (-1, -1)
        out, k = [], 0
        while k < len(elements):
            z = k + 1
            if g := elements[k][2]:
                while z < len(elements) and elements[z][2] == g:
                    z += 1
            own = []
            for j in range(k, z):
                e = elements[j]
                if j > k:
                    own.append("(?P<after>)" * (j == after) + "(?P<first>)" * (j == first))
                x = f"(?:{self._pattern(e[1])})++" if e[0] == "+" else self._char(e[1]) + ("?+" if e[0] == "#" else "")
                own.append(f"(?P<t{j}>{x})" if top and len(e) > 3 else x)
                if top and len(e) > 3:
                    self.texts.append(j)
            out.append("(?P<after>)" * (k == after) + "(?P<first>)" * (k == first))
            out.append(f"(?:{''.join(own)})?+" if g else "".join(own))
            k = z
        out.append("(?P<after>)" * (after == len(elements)))
        return "".join(out)

    def match(self, stream: list[str]):
        return self.pattern.fullmatch("".join(self.chars.get(t, UNKNOWN) for t in _plain(stream)))

    def learn(self, m, stream: list[str]) -> None:
        """Take in the texts of a page that matches."""
        mark, new = _mark(stream), []
        for e in self.elements:
            new.append(list(e))
        for j in self.texts:
            a, z = m.span(f"t{j}")
            if a < z:
                own, length = _told(stream[a:z])
                new[j][3:] = _read_too(new[j], own, [mark], length)
        if [(x[3], len(x[4])) for x in new if len(x) > 3] != [(x[3], len(x[4])) for x in self.elements if len(x) > 3]:
            self.__init__(new, None, self.depth, self.most)
        else:
            self.elements = new

    def article(self, stream: list[str]) -> tuple[int, int] | None:
        """Where the article stands in a page, or None if the wrapper does not tell."""
        m = self.main and self.match(stream)
        if not m:
            return None
        a, z = m.start("first"), m.start("after")
        if a < 0 or z <= a:
            return None
        if self.main[2]:
            return (a, z) if a and stream[a - 1][0] == "<" and _closed(stream).get(a - 1, len(stream)) == z else None
        for j in self.texts:  # what is left out must be the template's
            b, e = m.span(f"t{j}")
            if b < e and not self.main[0] <= j < self.main[1] and is_template(self.elements[j]) and _told(stream[b:e])[0] != self.elements[j][3]:
                return None
        return a, z

    def told(self) -> str:
        """What extraction needs, as text."""
        main = self.main
        cut = lambda j, e: e if main and not main[2] and is_template(e) and not main[0] <= j < main[1] else e[:3]
        return json.dumps([[cut(j, e) for j, e in enumerate(self.elements)], main, self.depth])

    @property
    def heads(self) -> frozenset:
        return frozenset(e[1][0][1] for e in self.elements if e[0] == "+")


def widened(wrapper: Wrapper | None, stream: list[str]) -> Wrapper | None:
    """The wrapper after one more page, or None if it would take too many elements."""
    if wrapper and wrapper.elements and (m := wrapper.match(stream)):
        wrapper.learn(m, stream)
        return wrapper
    if wrapper is None or not wrapper.elements:
        own = fold(stream)
        return Wrapper(own, most=_size(own))
    own = fold(stream, wrapper.heads)
    wider, most = align(wrapper.elements, own), max(wrapper.most, _size(own))
    return Wrapper(wider, most=most) if _fits(wider, most) else None


def _size(elements: list[list]) -> int:
    return sum(1 + (_size(e[1]) if e[0] == "+" else 0) for e in elements)


def _fits(elements: list[list], most: int) -> bool:
    return _size(elements) <= max(MOST_ELEMENTS, most * 5 // 4)


def merged(texts: list[str | None], most: int) -> list[list] | None:
    """The elements that cover several wrappers, written as text, or None if they or one of them would take too many."""
    if None in texts:
        return None
    out: list[list] = []
    for elements in filter(None, map(json.loads, sorted(texts))):
        out = align(out, elements) if out else elements
        if not _fits(out, most):
            return None
    return out


# ---- extraction -----------------------------------------------------------------------------------------------------
def article(found: list[tuple[str, str, str]], whole: bool = False) -> str:
    """The text of tokens: blocks one a line, without elements that are not the article's. Of a ``whole`` page, of which
    nothing tells where the article stands, headers go too."""
    blocks, line, skip = [], [], []
    for token, marks, text in found:
        if token in ("#", " "):
            if not skip:
                line.append(text)
            continue
        name = token[1:] if token[0] == "/" else _name(token)
        if skip:  # inside an element that is left out, until its own end
            if name == skip[0]:
                skip[1:] = [skip[1] + (1 if token[0] == "<" else -1)]
                if not skip[1]:
                    skip = []
            continue
        if name in BLOCKS:
            blocks.append("".join(line))
            line = []
        elif name == "br":
            line.append(" ")
        marked = name in CONTAINERS and any(_marks_aside(m) or whole and HEADER.match(m) for m in marks.split())
        if token[0] == "<" and name not in VOID and (name in SKIPPED or whole and name == "header" or marked):
            skip = [name, 1]
    blocks.append("".join(line))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract(page: str | None, *known: Wrapper | None) -> tuple[str, bool]:
    """The main text, and whether a wrapper told where it stands: the first that does so."""
    found = tokens(page) if page else []
    solid = [k for k, t in enumerate(found) if t[0] != " "]
    plain, lengths = [found[k][0] for k in solid], [len(found[k][2]) for k in solid]
    told = next(filter(None, (_told_by(w, found, plain, lengths) for w in known if w and w.main)), None)
    span = told or main_span(plain, lengths)
    a, z = span or (0, len(plain))
    a = solid[a] if a < len(solid) else len(found)
    z = solid[z] if z < len(solid) else len(found)
    return article(found[a:z], not span), bool(told)


def _told_by(w: Wrapper, found: list[tuple[str, str, str]], plain: list[str], lengths: list[int]) -> tuple[int, int] | None:
    """Where a wrapper says that the article of a page stands. One of shallow pages says nothing if that is all of the
    page, and tags inside may tell more."""
    if not w.depth:
        return w.article(plain if w.main[2] else valued(found))
    stream, places = shallow(valued(found), w.depth)
    span = w.article(stream)
    if not span:
        return None
    a, z = places[span[0]], places[span[1]]
    if (not a or _name(plain[a - 1]) in ("html", "body")) and (z == len(plain) or plain[z] in ("/html", "/body")):
        return None
    inner = None if w.main[2] else main_span(plain[a:z], lengths[a:z])
    if inner and 2 * sum(lengths[a + inner[0] : a + inner[1]]) >= sum(lengths[a:z]):
        a, z = a + inner[0], a + inner[1]
    return a, z


# ---- Spark ----------------------------------------------------------------------------------------------------------
def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def infer(pages: DataFrame, depths: tuple[int, ...] = (0,)) -> DataFrame:
    """(host, depth, wrapper): one wrapper a host and depth, from all of its pages; null if it takes too many elements.

    Each task folds its own pages of a host into one wrapper. Those are aligned again in parts of a host, and the parts by
    host, so a host with a third of all pages is one row a task, dealt over many tasks.
    """

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], Wrapper | None] = {}
        give = lambda: pd.DataFrame([(*k, w and json.dumps(w.elements), w.most if w else 0) for k, w in held.items()], columns=["host", "depth", "wrapper", "most"])
        for pdf in batches:
            for name, page in zip(pdf["host"], pdf["html"], strict=True):
                open_ = [k for d in depths if held.get(k := (name, d), True)] if page else []
                stream = valued(tokens(page)) if open_ else []
                read = nested(stream) if open_ and depths != (0,) else None
                for key in open_:
                    held[key] = widened(held.get(key), shallow(stream, key[1], read)[0] if key[1] else stream)
            if len(held) > HOSTS:
                yield give()
                held = {}
        if held:
            yield give()

    def together(pdf: pd.DataFrame) -> tuple[list[list] | None, int]:
        most = int(pdf["most"].max())
        return merged([w if isinstance(w, str) else None for w in pdf["wrapper"]], most), most

    def of_part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, most = together(pdf)
        return pd.DataFrame({"host": [key[0]], "depth": [key[1]], "wrapper": [None if own is None else json.dumps(own)], "most": [most]})

    def of_host(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, _ = together(pdf)
        return pd.DataFrame({"host": [key[0]], "depth": [key[1]], "wrapper": [None if own is None else Wrapper(own, depth=int(key[1])).told()]})

    named = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    schema = "host string, depth int, wrapper string, most int"
    own = named.mapInPandas(of_task, schema).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    parts = own.groupBy("host", "depth", "part").applyInPandas(of_part, schema)
    return parts.groupBy("host", "depth").applyInPandas(of_host, "host string, depth int, wrapper string")


def inferred(pages: DataFrame) -> DataFrame:
    """(host, wrapper), a stored table: the wrapper of a host's whole pages in a list, or those of its shallow pages, the
    deepest first and those without classes last, where whole pages take too many elements."""
    found = [stored(infer(pages), "wrappers")]
    full = found[0].where("wrapper is null").select(F.col("host").alias("full"))
    for depths in (DEPTHS, tuple(-d for d in DEPTHS)):
        if full.isEmpty():
            break
        own = pages.select("url", "html").join(small_side(full), host(F.col("url")) == F.col("full"), "left_semi")
        found.append(stored(infer(own, depths), "wrappers-shallow"))
        reached = F.max(F.when(F.col("wrapper").isNotNull(), F.col("depth")))
        full = found[-1].groupBy(F.col("host").alias("full")).agg(F.coalesce(reached, F.lit(0)).alias("reached")).where(F.col("reached") < ENOUGH_DEEP).select("full")
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    by_depth = F.array_sort(F.collect_list(F.struct(F.expr("depth < 0"), -F.abs("depth"), "wrapper")))
    return stored(every.where("wrapper is not null").groupBy("host").agg(F.array_join(by_depth["wrapper"], ",").alias("wrapper")), "wrappers-by-host")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, wrapped: the article of each page.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and readers' comments are left
    out; a block is a line, white space in it one space. All pages of a host count in its wrappers, however different; a
    page that none of them matches is read by its own elements (wrapped is false). A null or empty html gives an empty
    text, a null url counts as host ''; repeated rows are read alike and other columns are left out.
    """
    found = inferred(pages).select("host", F.concat(F.lit("["), "wrapper", F.lit("]")).alias("wrapper"))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    joined = rows.join(small_side(found, 8_000_000, F.length("wrapper")), "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[Wrapper]] = {}
        for pdf in batches:
            texts, flags = [], []
            for page, w in zip(pdf["html"], pdf["wrapper"], strict=True):
                if w and w not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    known[w] = [Wrapper(*x) for x in json.loads(w)]
                text, wrapped = extract(page, *(known[w] if w else ()))
                texts.append(text)
                flags.append(wrapped)
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "wrapped": flags})

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long").add("wrapped", "boolean")
    return joined.mapInPandas(run, schema)
