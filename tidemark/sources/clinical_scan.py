"""Parts of many clinical XML documents taken at once, column by column.

Spark's XML reader builds a nested row for every element of ``schemas.CLINICAL_DOCUMENT``, which costs
several times as much as checking that a document is well-formed. Here the tags of a batch of texts are
found and nested with array operations, and only the parts that rows need are cut out. A text is
``plain`` when this gives what the reader would: one root, no comments, CDATA or document type, no
references or line breaks in a value that is taken, names in the spelling of the schema. Any other text is
not plain and left to the reader, and whether tags match and attributes are sound is the reader's to say
for every text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.clinical import LOINC_OID

# Root namespace and the section codes.
NAMESPACE = "urn:hl7-org:v3"
VITALS, RESULTS, PROBLEMS, MEDICATIONS = "8716-3", "30954-2", "11450-4", "10160-0"

#: Parts of an observation, a problem and a medication, all text.
CODED = ("code", "oid", "display")
VITAL = (*CODED, "time", "kind", "number", "unit", "txt")
RESULT = (
    *VITAL, "value_code", "value_display", "translated", "translated_unit", "spelled",
    "low", "low_unit", "high", "high_unit",
)
PROBLEM = (*CODED, "status", "onset")
MEDICATION = (*CODED, "status", "dose", "dose_unit", "route", "start", "end")
LISTS = {"vitals": VITAL, "results": RESULT, "problems": PROBLEM, "medications": MEDICATION}


def struct_of(names: tuple[str, ...]) -> str:
    return f"struct<{', '.join(f'{n}: string' for n in names)}>"


SCANNED = (
    "struct<plain: boolean, start: int, time: string, "
    + ", ".join(f"{name}: array<{struct_of(parts)}>" for name, parts in LISTS.items()) + ">"
)

_BOUNDS = {"low": {}, "high": {}}
_OBSERVATION = {
    "code": {}, "statusCode": {}, "effectiveTime": _BOUNDS,
    "value": {"translation": {"originalText": {}}, "originalText": {}, **_BOUNDS},
}
_DRUG = {"manufacturedProduct": {"manufacturedMaterial": {"code": {}}}}
_ENTRY = {
    "organizer": {"component": {"observation": _OBSERVATION}}, "observation": _OBSERVATION,
    "act": {"entryRelationship": {"observation": _OBSERVATION}},
    "substanceAdministration": {
        "consumable": _DRUG, "statusCode": {}, "doseQuantity": {}, "routeCode": {}, "effectiveTime": _BOUNDS},
}
#: Elements of ``schemas.CLINICAL_DOCUMENT``.
TREE = {
    "templateId": {}, "effectiveTime": {},
    "component": {"structuredBody": {"component": {"section": {"code": {}, "entry": _ENTRY}}}},
}
#: Names of fields that are no elements; an element of that name would be read into them.
_RESERVED = ("txt", "malformed")
_ATTRIBUTES = ("value", "unit", "code", "codeSystem", "displayName", "type")
_VALUE, _UNIT, _CODE, _SYSTEM, _DISPLAY, _TYPE = range(6)


def _flat(tree: dict) -> list[tuple[str, ...]]:
    """Paths of all elements; their number in this list, from 2 on, is the element's node. 1 is the root, 0 any other element."""
    paths = [()]
    for path in paths:
        at = tree
        for name in path:
            at = at[name]
        paths += [(*path, name) for name in at]
    return paths


_PATHS = _flat(TREE)
_NODE = {"/".join(path): i + 1 for i, path in enumerate(_PATHS)}
_NAMES = sorted({path[-1] for path in _PATHS if path})
_NEXT = np.zeros((len(_PATHS) + 1, len(_NAMES) + 1), np.int16)
for _path in _PATHS[1:]:
    _NEXT[_NODE["/".join(_path[:-1])], _NAMES.index(_path[-1]) + 1] = _NODE["/".join(_path)]
_LEVELS = max(map(len, _PATHS)) + 1
_SECTION = "component/structuredBody/component/section"


def _nodes(*names: str) -> np.ndarray:
    """For each node whether its element has one of these names."""
    out = np.zeros(len(_PATHS) + 1, bool)
    for path, node in _NODE.items():
        out[node] = path.rpartition("/")[2] in names
    return out


_WITH_TEXT = _nodes("value", "originalText")
#: Elements whose attributes are taken.
_WITH_ATTRIBUTES = _nodes(
    "code", "effectiveTime", "value", "translation", "low", "high", "statusCode", "doseQuantity", "routeCode")

_LT, _GT, _QUOTE, _SPACE, _COLON, _SLASH, _AMP = range(1, 8)
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((b"<", _LT), (b">", _GT), (b"\"'", _QUOTE), (b" \t\n\r", _SPACE), (b":", _COLON), (b"/", _SLASH), (b"&", _AMP)):
    _CLASS[list(_chars)] = _kind

_DECLARATION = re.compile(
    rb"""<\?xml\s+version\s*=\s*["']1\.0["'](?:\s+encoding\s*=\s*["'][Uu][Tt][Ff]-8["'])?(?:\s+standalone\s*=\s*["'](?:yes|no)["'])?\s*\?>""")
_ROOT = re.compile(rb"<(?:(\w+):)?ClinicalDocument(?=[\s>])([^>]*)>")
#: Bytes of text worked on together, which bounds a task's memory.
CHUNK = 1 << 22
#: The reader's own limits are wider.
_DEEPEST, _MOST, _WIDEST = 500, 500, 1 << 18
_PAD = 32


@lru_cache(1024)
def _is_declaration(tag: bytes) -> bool:
    return _DECLARATION.fullmatch(tag) is not None


@lru_cache(1024)
def _is_root(tag: bytes) -> bool:
    found = _ROOT.fullmatch(tag)
    if found is None or tag.endswith(b"/>"):
        return False
    name = rb"xmlns" + (b":" + found[1] if found[1] else b"")
    return re.search(rb"(?:^|\s)" + name + rb"\s*=\s*[\"']" + NAMESPACE.encode() + rb"[\"']", found[2]) is not None


def scan(text: Column) -> Column:
    """Whether a text is plain, where its root begins, and its parts: a struct as ``SCANNED``."""
    return F.arrow_udf(scan_texts, SCANNED)(text)


def scan_texts(texts: pa.Array) -> pa.Array:
    """A batch of texts, in chunks of bounded size."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, ends, data = texts.buffers()
    if n == 0 or data is None:
        return _nothing(n)
    offsets = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)
    given = ~texts.is_null().to_numpy(zero_copy_only=False)
    found, first = [], 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        if last == first + 1 and offsets[last] - offsets[first] > 16 * CHUNK:
            found.append(_nothing(1))  # so large a text is read by itself
        else:
            found.append(_Chunk(data, offsets[first:last + 1], given[first:last]).scanned())
        first = last
    return pa.concat_arrays(found)


def _nothing(n: int) -> pa.Array:
    empty = [pa.array([None] * n, _arrow_list(parts)) for parts in LISTS.values()]
    return pa.StructArray.from_arrays(
        [pa.array([False] * n), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.string()), *empty],
        ["plain", "start", "time", *LISTS])


def _arrow_list(parts: tuple[str, ...]) -> pa.DataType:
    return pa.list_(pa.struct([(p, pa.string()) for p in parts]))


def _word(part: bytes) -> int:
    return int.from_bytes(part.ljust(8, b"\0"), "little")


#: Bits that differ between upper and lower case; other characters may meet as well.
_FOLD = 0x2020202020202020
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Names:
    """Names to be found by length and first eight bytes, numbered from 1 on as given."""

    def __init__(self, names: tuple[str, ...]) -> None:
        coded = [n.encode() for n in names]
        keys = np.array([self._key(_word(n[:8]) | _FOLD & int(_MASKS[min(len(n), 8)]), len(n)) for n in coded], np.uint64)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], (order + 1).astype(np.int16)
        self.words = [np.array([_word(coded[i][8 * k:8 * k + 8]) for i in order], np.uint64) for k in range(3)]
        self.masks = [np.array([_MASKS[min(max(len(coded[i]) - 8 * k, 0), 8)] for i in order], np.uint64) for k in range(3)]
        self.longest = max(map(len, coded))

    @staticmethod
    def _key(word: int, length: int) -> int:
        return (word ^ length * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF

    def find(self, eight: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each name, else 0; and the places of names much like one of these, but not equal."""
        first = eight[start]
        mask = _MASKS[np.clip(length, 0, 8)]
        key = ((first | np.uint64(_FOLD)) & mask) ^ length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        like = np.flatnonzero(self.keys[at] == key)
        at = at[like]
        same = (first[like] & self.masks[0][at]) == self.words[0][at]
        for k in (1, 2):
            more = np.flatnonzero(length[like] > 8 * k)
            word = eight[start[like[more]] + 8 * k] & self.masks[k][at[more]]
            same[more] &= word == self.words[k][at[more]]
        out = np.zeros(len(start), np.int16)
        out[like[same]] = self.number[at[same]]
        return out, like[~same]


_ELEMENT_NAMES = _Names((*_NAMES, *_RESERVED))
_ATTRIBUTE_NAMES = _Names(_ATTRIBUTES)


class _Chunk:
    """Texts side by side; positions are relative to the first. ``bad`` marks texts found not plain."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, given: np.ndarray) -> None:
        size = int(offsets[-1] - offsets[0])
        self.data = np.zeros(size + _PAD, np.uint8)
        self.data[:size] = data[offsets[0]:offsets[-1]]
        self.eight = np.ndarray((size + _PAD - 7,), "<u8", self.data, strides=(1,))
        self.off = offsets - offsets[0]
        self.n = len(given)
        self.bad = ~given
        self.size = size

    # Texts and tags ----------------------------------------------------------

    def scanned(self) -> pa.Array:
        self.mark = self._marks()
        self.kind = _CLASS[self.data[self.mark]]
        self.spaces, self.references = (self.mark[self.kind == k] for k in (_SPACE, _AMP))
        self.breaks = self.spaces[self.data[self.spaces] != 32]
        if not self._tags(np.flatnonzero(self.kind == _LT), np.flatnonzero(self.kind == _GT)) or not self._elements():
            return _nothing(self.n)
        self._texts()
        self._attributes()
        return self._parts()

    def _marks(self) -> np.ndarray:
        """Places of all characters of a kind, and of the padding behind the texts."""
        data = self.data
        found = data <= 32
        for one in (34, 47, 58):
            found |= data == one
        found |= (data | 1) == 39
        found |= (data | 2) == 62
        return np.flatnonzero(found)

    def _tags(self, open_: np.ndarray, end: np.ndarray) -> bool:
        """Tags that open and end in turns, one root a text; ``open_`` and ``end`` are numbers of marks."""
        lt, gt = self.mark[open_], self.mark[end]
        n_lt, n_gt = (np.diff(np.searchsorted(x, self.off)) for x in (lt, gt))
        self.bad |= (n_lt != n_gt) | (n_lt < 2)
        doc = np.repeat(np.arange(self.n), n_lt)
        keep, keep_gt = ~self.bad[doc], ~self.bad[np.repeat(np.arange(self.n), n_gt)]
        lt, gt, doc, open_, end = lt[keep], gt[keep_gt], doc[keep], open_[keep], end[keep_gt]
        self.bad[doc[lt > gt]] = True
        self.bad[doc[:-1][(gt[:-1] > lt[1:]) & (doc[:-1] == doc[1:])]] = True

        second = self.data[lt + 1]
        close, declared = second == 47, second == 63
        self.bad[doc[second == 33]] = True
        single = (self.data[gt - 1] == 47) & ~close & ~declared
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        self.bad[doc[declared & ~first]] = True
        self.bad[doc[first & (lt != self.off[doc])]] = True
        self.lt, self.gt, self.doc = lt, gt, doc
        self._check(np.flatnonzero(declared & first & ~self.bad[doc]), _is_declaration)

        # how deep a text is after each of its tags
        step = np.where(close, -1, 1)
        step[single | declared] = 0
        depth = np.cumsum(step)
        start = np.flatnonzero(first)
        if not start.size:
            return False
        depth = depth - np.repeat(depth[start] - step[start], np.diff(np.append(start, len(doc))))
        last = np.append(first[1:], True)
        self.bad[doc[(depth < 0) | ((depth == 0) & ~last & ~declared) | (last & (depth != 0)) | (depth > _DEEPEST)]] = True

        keep = ~self.bad[doc]
        self.lt, self.gt, self.doc, self.depth = lt[keep], gt[keep], doc[keep], depth[keep]
        self.open_mark, self.end_mark = open_[keep], end[keep]
        self.close, self.single, self.declared, self.last = close[keep], single[keep], declared[keep], last[keep]
        return self.lt.size > 0

    def _same(self, start: np.ndarray, value: str) -> np.ndarray:
        """Whether the bytes from ``start`` on are this value."""
        out = np.ones(len(start), bool)
        data = value.encode()
        for at in range(0, len(data), 8):
            part = data[at:at + 8]
            out &= (self.eight[start + at] & _MASKS[len(part)]) == np.uint64(_word(part))
        return out

    def _check(self, token: np.ndarray, good) -> None:
        """A text is not plain if its one tag of these is not good; tags of a batch are mostly alike."""
        for _ in range(4):
            if not token.size:
                return
            begin, end = self.lt[token[0]], self.gt[token[0]] + 1
            tag = self.data[begin:end]
            alike = self.gt[token] + 1 - self.lt[token] == len(tag)
            alike[alike] = (self.data[self.lt[token[alike]][:, None] + np.arange(len(tag))] == tag).all(axis=1)
            if not good(tag.tobytes()):
                self.bad[self.doc[token[alike]]] = True
            token = token[~alike]
        for t in token:
            if not good(self.data[self.lt[t]:self.gt[t] + 1].tobytes()):
                self.bad[self.doc[t]] = True

    # Elements ----------------------------------------------------------------

    def _elements(self) -> bool:
        """Nodes and parents of all elements, level by level."""
        tag = np.flatnonzero(~self.close & ~self.declared)
        doc = self.doc[tag]
        after = self.open_mark[tag] + 1
        prefixed = self.kind[after] == _COLON
        start = np.where(prefixed, self.mark[after], self.lt[tag]) + 1
        after += prefixed
        end, kind = self.mark[after], self.kind[after]
        self.bad[doc[(kind != _SPACE) & (kind != _GT) & (kind != _SLASH)]] = True
        name, unlike = _ELEMENT_NAMES.find(self.eight, start, end - start)
        self.bad[doc[unlike]] = True
        self.bad[doc[(name > len(_NAMES)) | (self.data[start] == 95) | (end <= start)]] = True
        name[name > len(_NAMES)] = 0

        single = self.single[tag]
        depth = self.depth[tag] + single
        order = np.argsort(depth.astype(np.int16), kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(_LEVELS + 2))
        node = np.zeros(len(tag), np.int16)
        parent = np.zeros(len(tag), np.int64)
        opened = []
        for level in range(1, _LEVELS + 1):
            here = order[bounds[level]:bounds[level + 1]]
            if level == 1:
                node[here] = 1
                self._check(tag[here], _is_root)
            elif here.size:
                parent[here] = opened[-1][np.searchsorted(opened[-1], here) - 1]
                node[here] = _NEXT[node[parent[here]], name[here]]
            opened.append(here[~single[here]])
            if not node[here].any():
                break
        self.tag, self.edoc, self.node, self.parent, self.opened = tag, doc, node, parent, opened
        self.by_node = np.argsort(node, kind="stable")
        self.nodes = np.searchsorted(node[self.by_node], np.arange(len(_PATHS) + 2))
        return True

    def _texts(self) -> None:
        """Text of the elements that may have some; text in other elements of the schema is not plain."""
        n = len(self.tag)
        self.text_start, self.text_end = np.full(n, -1), np.full(n, -1)
        element = np.full(len(self.lt), -1)
        element[self.tag] = np.arange(n)
        ends = np.append(self.lt[1:], 0)
        ends[self.last] = self.off[self.doc[self.last] + 1]
        gap = np.flatnonzero(ends - self.gt > 1)
        spaces = self.spaces
        begin, end = self.gt[gap] + 1, ends[gap]
        blank = np.searchsorted(spaces, end) - np.searchsorted(spaces, begin) == end - begin
        depth = self.depth[gap]
        self.bad[self.doc[gap[(depth == 0) & ~blank]]] = True
        opens = element[gap]
        leaf = (opens >= 0) & ~self.single[gap]
        leaf &= np.append(self.close, False)[gap + 1]
        # an element of text alone
        own = np.flatnonzero(leaf)
        own = own[_WITH_TEXT[self.node[opens[own]]]]
        first, last = begin[own], end[own]
        unlike = blank[own] | self._has(self.references, first, last) | self._has(self.breaks, first, last)
        unlike |= (self.data[first] <= 32) | (self.data[last - 1] <= 32)
        self.bad[self.doc[gap[own[unlike]]]] = True
        self.text_start[opens[own]], self.text_end[opens[own]] = first, last
        # text of any other element of the schema
        rest = ~blank & (depth > 0)
        rest[own] = False
        for level in np.unique(depth[rest]):
            if level > len(self.opened):
                continue
            here = gap[rest & (depth == level)]
            opened = self.opened[level - 1]
            owner = opened[np.searchsorted(self.tag[opened], here, "right") - 1]
            self.bad[self.doc[here[self.node[owner] > 0]]] = True

    @staticmethod
    def _has(places: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not places.size:
            return np.zeros(len(first), bool)
        return np.searchsorted(places, last) > np.searchsorted(places, first)

    def _attributes(self) -> None:
        """Where the values of the attributes in use begin and end, -1 without one."""
        quote = self.kind == _QUOTE
        quotes = np.flatnonzero(quote)
        before = np.cumsum(quote)
        own = np.flatnonzero(_WITH_ATTRIBUTES[self.node])
        tag = self.tag[own]
        low, high = before[self.open_mark[tag]], before[self.end_mark[tag]]
        n = (high - low) // 2
        self.bad[self.edoc[own[((high - low) % 2 == 1) | (n > _MOST)]]] = True
        e = np.repeat(own, n)
        first = np.repeat(low - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(n.sum())
        opens = quotes[first]
        opening, closing = self.mark[opens], self.mark[quotes[first + 1]]
        doc = self.edoc[e]
        prefixed = self.kind[opens - 1] == _COLON
        space = opens - 1 - prefixed
        begin, start = self.mark[space] + 1, self.mark[opens - 1] + 1
        wrong = (self.data[opening] != self.data[closing]) | (self.data[opening - 1] != 61)
        wrong |= (self.kind[space] != _SPACE) | (start >= opening - 1)
        self.bad[doc[wrong]] = True
        declares = np.where(prefixed, start - 1, opening - 1) - begin == 5
        declares[declares] = self._same(begin[declares], "xmlns")
        name, unlike = _ATTRIBUTE_NAMES.find(self.eight, start, opening - 1 - start)
        self.bad[doc[unlike]] = True
        use = np.flatnonzero((name > 0) & ~declares)
        e, doc, name, begin, end = e[use], doc[use], name[use] - 1, opening[use] + 1, closing[use]
        unlike = self._has(self.references, begin, end) | self._has(self.breaks, begin, end) | (end - begin > _WIDEST)
        unlike |= (begin == end) | (self.data[begin] == 32) | (self.data[end - 1] == 32)
        self.bad[doc[unlike]] = True
        place = e * len(_ATTRIBUTES) + name
        self.from_, self.to = (np.full(len(self.tag) * len(_ATTRIBUTES), -1) for _ in range(2))
        self.from_[place], self.to[place] = begin, end
        self.bad[doc[self.from_[place] != begin]] = True  # the same name twice, with two prefixes

    # Parts -------------------------------------------------------------------

    def _of(self, e: np.ndarray, attribute: int) -> tuple[np.ndarray, np.ndarray]:
        """Value of an attribute of elements; -1 as element has none."""
        place = np.maximum(e, 0) * len(_ATTRIBUTES) + attribute
        return np.where(e < 0, -1, self.from_[place]), np.where(e < 0, -1, self.to[place])

    def _is(self, span: tuple[np.ndarray, np.ndarray], value: str) -> np.ndarray:
        out = span[1] - span[0] == len(value)
        here = np.flatnonzero(out & (span[0] >= 0))
        out[:] = False
        out[here[self._same(span[0][here], value)]] = True
        return out

    def _at(self, *paths: str) -> np.ndarray:
        """The elements of these paths, as they stand in the texts."""
        spans = [self.by_node[self.nodes[k]:self.nodes[k + 1]] for k in (_NODE[path] for path in paths)]
        return spans[0] if len(spans) == 1 else np.sort(np.concatenate(spans))

    def _first(self, child: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The elements that have such children, and the first child of each."""
        if chosen is not None:
            child = child[chosen]
        parent = self.parent[child]
        new = np.ones(len(child), bool)
        new[1:] = parent[1:] != parent[:-1]
        return parent[new], child[new]

    @staticmethod
    def _child(firsts: tuple[np.ndarray, np.ndarray], e: np.ndarray) -> np.ndarray:
        """Of each element its first child, -1 without one or without an element."""
        parent, child = firsts
        if not parent.size:
            return np.full(len(e), -1)
        at = np.minimum(np.searchsorted(parent, e), len(parent) - 1)
        return np.where(parent[at] == e, child[at], -1)

    def _up(self, e: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            e = self.parent[e]
        return e

    def _parts(self) -> pa.Array:
        body = self._at("component/structuredBody")
        first_body = np.zeros(len(self.tag), bool)
        first_body[body[np.unique(self.edoc[body], return_index=True)[1]]] = True
        section = self._at(_SECTION)
        section = self._first(section)[1]
        section = section[first_body[self._up(section, 2)]]

        # sections by the code they have; one with two of the codes is not plain
        code = self._at(f"{_SECTION}/code")
        code = code[self._is(self._of(code, _SYSTEM), LOINC_OID)]
        kind = np.zeros(len(self.tag), np.int8)
        for k, loinc in enumerate((VITALS, RESULTS, PROBLEMS, MEDICATIONS), 1):
            of_kind = self.parent[code[self._is(self._of(code, _CODE), loinc)]]
            self.bad[self.edoc[of_kind[(kind[of_kind] > 0) & (kind[of_kind] != k)]]] = True
            kind[of_kind] = k
        counted = np.zeros(len(self.tag), np.int8)
        counted[section] = kind[section]

        entry = f"{_SECTION}/entry"
        panel, direct = f"{entry}/organizer/component/observation", f"{entry}/observation"
        noted, drug = f"{entry}/act/entryRelationship/observation", f"{entry}/substanceAdministration"

        def within(path: str, steps: int, k: int) -> np.ndarray:
            found = self._at(path)
            return found[counted[self._up(found, steps)] == k]

        of_panel, of_entry = within(panel, 4, 2), within(direct, 2, 2)
        result = np.concatenate([of_panel, of_entry])
        result = result[np.argsort(self.edoc[result], kind="stable")]
        vital, problem, medication = within(panel, 4, 1), within(noted, 4, 3), within(drug, 2, 4)

        observed = (panel, direct, noted)

        def children(*names: str, of=observed) -> np.ndarray:
            return self._at(*(f"{path}/{name}" for path in of for name in names))

        def first(name: str, e: np.ndarray, of=observed) -> np.ndarray:
            return self._child(self._first(children(name, of=of)), e)

        def coded(e: np.ndarray) -> list:
            return [self._of(e, a) for a in (_CODE, _SYSTEM, _DISPLAY)]

        def text(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.where(e < 0, -1, self.text_start[e]), np.where(e < 0, -1, self.text_end[e])

        def observation(e: np.ndarray, v: np.ndarray) -> list:
            return [
                *coded(first("code", e)), self._of(first("effectiveTime", e), _VALUE),
                *(self._of(v, a) for a in (_TYPE, _VALUE, _UNIT)), text(v)]

        def vital_parts(e: np.ndarray) -> list:
            return observation(e, first("value", e))

        def result_parts(e: np.ndarray) -> list:
            v = first("value", e)
            translation, low, high = (first(f"value/{name}", v) for name in ("translation", "low", "high"))
            # a unit is spelled out in the value itself, else in any translation, and without a translation not read
            own = first("value/originalText", v)
            of_translation = self._first(children("value/translation/originalText"))[1]
            owner, place = np.unique(self._up(of_translation, 2), return_index=True)
            spelled = np.where(own >= 0, own, self._child((owner, of_translation[place]), v))
            return [
                *observation(e, v), self._of(v, _CODE), self._of(v, _DISPLAY),
                self._of(translation, _VALUE), self._of(translation, _UNIT), text(np.where(translation < 0, -1, spelled)),
                self._of(low, _VALUE), self._of(low, _UNIT), self._of(high, _VALUE), self._of(high, _UNIT),
            ]

        def problem_parts(e: np.ndarray) -> list:
            value = children("value")
            coded_value = self._child(self._first(value, self._is(self._of(value, _TYPE), "CD")), e)
            onset = first("effectiveTime/low", first("effectiveTime", e))
            return [*coded(coded_value), self._of(first("statusCode", e), _CODE), self._of(onset, _VALUE)]

        def medication_parts(e: np.ndarray) -> list:
            of = (drug,)
            inner, path = e, []
            for name in ("consumable", "manufacturedProduct", "manufacturedMaterial", "code"):
                path.append(name)
                inner = first("/".join(path), inner, of)
            dose, taken = first("doseQuantity", e, of), children("effectiveTime", of=of)
            period = self._child(self._first(taken, self._is(self._of(taken, _TYPE), "IVL_TS")), e)
            return [
                *coded(inner), self._of(first("statusCode", e, of), _CODE), self._of(dose, _VALUE), self._of(dose, _UNIT),
                self._of(first("routeCode", e, of), _DISPLAY),
                *(self._of(first(f"effectiveTime/{bound}", period, of), _VALUE) for bound in ("low", "high")),
            ]

        template, time = self._at("templateId"), self._at("effectiveTime")
        named = np.zeros(self.n, bool)
        named[self.edoc[template]] = True
        self.bad |= ~named
        dates = np.full(self.n, -1)
        dated, place = np.unique(self.edoc[time], return_index=True)
        dates[dated] = time[place]
        start = np.zeros(self.n, np.int32)
        root = self.opened[0]
        start[self.edoc[root]] = self.lt[self.tag[root]] - self.off[self.edoc[root]]

        lists = [
            self._list(vital, VITAL, vital_parts), self._list(result, RESULT, result_parts),
            self._list(problem, PROBLEM, problem_parts), self._list(medication, MEDICATION, medication_parts),
        ]
        return pa.StructArray.from_arrays(
            [pa.array(~self.bad), pa.array(start), self._strings(self._of(dates, _VALUE)), *lists],
            ["plain", "start", "time", *LISTS])

    def _list(self, e: np.ndarray, names: tuple[str, ...], parts) -> pa.Array:
        e = e[~self.bad[self.edoc[e]]]
        ends = np.zeros(self.n + 1, np.int32)
        np.cumsum(np.bincount(self.edoc[e], minlength=self.n), out=ends[1:])
        rows = pa.StructArray.from_arrays([self._strings(span) for span in parts(e)], list(names))
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    def _strings(self, span: tuple[np.ndarray, np.ndarray]) -> pa.Array:
        """Strings cut out of the texts; null from -1 on."""
        first, last = span
        held = first >= 0
        length = np.where(held, last - first, 0)
        ends = np.zeros(len(first) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        data = self.data[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
        return pa.StringArray.from_buffers(
            len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data),
            pa.py_buffer(np.packbits(held, bitorder="little")), int((~held).sum()))
