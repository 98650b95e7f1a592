"""Places in an XML part that hold text: found once, read for detection, and written back in place.

A slot is a piece of text and the stretches of the part that spell it. Reading and writing use the same slots, so
they can't get out of step. The part is scanned as a string, not parsed: the rest of it stays as it is, byte by byte.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def unescape(text: str) -> str:
    """The five named entities, in this order; numeric ones stay."""
    if "&" not in text:
        return text
    for name, char in ENTITIES:
        text = text.replace(name, char)
    return text


def escape(text: str) -> str:
    for name, char in ENTITIES[:4]:
        text = text.replace(char, name)
    return text


@dataclass
class Slot:
    text: str
    spans: list[tuple[int, int]]


Finder = Callable[[str], list[Slot]]


def _slot(xml: str, spans: list[tuple[int, int]]) -> Slot:
    return Slot("".join(unescape(xml[a:b]) for a, b in spans), spans)


@functools.cache
def _opening(tag: str) -> re.Pattern[str]:
    return re.compile(rf"<{re.escape(tag)}(?=[\s/>])[^>]*>")


def _opens(xml: str, tag: str, start: int = 0, end: int | None = None) -> Iterable[re.Match[str]]:
    return _opening(tag).finditer(xml, start, len(xml) if end is None else end)


def _inner(xml: str, tag: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Stretches between an opening tag and the next closing one."""
    out, after = [], start
    for m in _opens(xml, tag, start, end):
        if m.start() < after or m[0].endswith("/>"):
            continue
        stop = xml.find(f"</{tag}>", m.end(), len(xml) if end is None else end)
        if stop < 0:
            break
        out.append((m.end(), stop))
        after = stop
    return out


def runs(outer: str, inner: str) -> Finder:
    """One slot for each ``outer`` element: the text of the ``inner`` elements that are in it and in no ``outer`` within it.

    Paragraphs of text boxes, cells and headers stand within other paragraphs; text after them still belongs to the
    outer one. Slots come in the order in which the elements open.
    """
    tags = re.compile(rf"<(?P<close>/?){re.escape(outer)}(?=[\s/>])[^>]*>|<{re.escape(inner)}(?=[\s/>])[^>]*>")

    def find(xml: str) -> list[Slot]:
        spans: list[list[tuple[int, int]]] = []
        inside: list[int] = []
        for m in tags.finditer(xml):
            if m["close"]:
                if inside:
                    inside.pop()
            elif m[0].endswith("/>"):
                continue
            elif m["close"] == "":
                inside.append(len(spans))
                spans.append([])
            elif inside and (stop := xml.find(f"</{inner}>", m.end())) >= 0:
                spans[inside[-1]].append((m.end(), stop))
        return [_slot(xml, s) for s in spans]

    return find


def contents(tag: str) -> Finder:
    """The text of each element that isn't blank."""
    return lambda xml: [_slot(xml, [(a, b)]) for a, b in _inner(xml, tag) if xml[a:b].strip()]


def first_contents(*tags: str, blank: bool = False) -> Finder:
    """The text of the first element of each tag, tag by tag."""
    return lambda xml: [_slot(xml, [found[0]]) for tag in tags if (found := _inner(xml, tag)) and (xml[found[0][0] : found[0][1]].strip() or blank and found[0][0] < found[0][1])]


def text_nodes(xml: str) -> list[Slot]:
    """What stands between tags and isn't blank."""
    return [_slot(xml, [m.span(1)]) for m in re.finditer(r">([^<>]+)(?=<)", xml) if m[1].strip()]


def attribute(tag: str, name: str) -> Finder:
    """The values of an attribute that aren't blank."""
    value = re.compile(rf"{re.escape(name)}=(?:\"([^\"]*)\"|'([^']*)')")

    def find(xml: str) -> list[Slot]:
        out = []
        for m in _opens(xml, tag):
            if v := value.search(xml, m.start(), m.end()):
                a, b = v.span(1) if v[1] is not None else v.span(2)
                if xml[a:b].strip():
                    out.append(_slot(xml, [(a, b)]))
        return out

    return find


def in_order(*finders: Finder) -> Finder:
    """Slots of each finder, one finder after the other."""
    return lambda xml: [slot for find in finders for slot in find(xml)]


def by_place(*finders: Finder) -> Finder:
    """Slots of all finders as they come in the part."""
    return lambda xml: sorted((slot for find in finders for slot in find(xml)), key=lambda s: s.spans[0])


def cells(xml: str) -> list[Slot]:
    """Inline strings and plain values of cells; a cell that points to a shared string has its text there."""
    out, after = [], 0
    for m in re.finditer(r"<c(?=[ >])[^>]*>", xml):
        if m.start() < after or m[0].endswith("/>"):
            continue
        stop = xml.find("</c>", m.end())
        if stop < 0:
            break
        after = stop
        if 't="s"' in m[0] or "t='s'" in m[0]:
            continue
        if inline := _inner(xml, "is", m.end(), stop):
            out.append(_slot(xml, _inner(xml, "t", *inline[0])))
        elif value := _inner(xml, "v", m.end(), stop):
            out.append(_slot(xml, value[:1]))
    return out




def fill(xml: str, slots: list[Slot], texts: list[str]) -> str:
    """The part with new texts: a changed one goes whole into its slot's first stretch, the slot's others become empty."""
    changes = []
    for slot, text in zip(slots, texts, strict=True):
        if text != slot.text and slot.spans:
            changes += [(span, escape(text) if i == 0 else "") for i, span in enumerate(slot.spans)]
    out, at = [], 0
    for (a, b), new in sorted(changes):
        if a >= at:
            out += [xml[at:a], new]
            at = b
    return "".join([*out, xml[at:]])
