"""The top level of a YAML mapping: keys and their scalar values, as far as a configuration check needs them.

Block and flow mappings, plain, quoted, literal and folded scalars, comments, anchors, aliases and tags are read; what lies deeper is skipped but has to
be closed. Values that are no scalars are None, as null is. Raises ``ValueError`` for what is no YAML.
"""

from __future__ import annotations

import re

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "/": "/", "\\": "\\", " ": " ", "e": "\x1b", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "_": "\xa0"}
_PROPERTIES = re.compile(r"(?:(?:&(?P<anchor>[^\s,\[\]{}]+)|![^\s,\[\]{}]*)(?:\s+|$))+")


def _uncommented(line: str) -> str:
    """A line without its comment; a mark within quotes is none."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (not i or line[i - 1] in " \t:,[{-"):
            quote = c
        elif c == "#" and (not i or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The quoted scalar that begins at a place, and where it ends; line breaks within are blanks."""
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if quote == "'" and text[i : i + 2] == "''":
            out.append("'")
            i += 2
        elif c == quote:
            return re.sub(r"[ \t]*\n\s*", " ", "".join(out)), i + 1
        elif quote == '"' and c == "\\":
            code = re.match(r"x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}", text[i + 1 :])
            if code:
                out.append(chr(int(code[0][1:], 16)))
            elif text[i + 1 : i + 2] not in _ESCAPES:
                raise ValueError("unknown escape")
            else:
                out.append(_ESCAPES[text[i + 1]])
            i += 1 + (len(code[0]) if code else 1)
        else:
            out.append(c)
            i += 1
    raise ValueError("a quote is not closed")


def _flow(text: str, at: int) -> tuple[object, int]:
    """The flow value that begins at a place, and where it ends: a dict, a list (None) or a scalar."""
    at += len(text[at:]) - len(text[at:].lstrip())
    p = _PROPERTIES.match(text, at)
    at = p.end() if p else at
    if at >= len(text):
        raise ValueError("a bracket is not closed")
    if text[at] in "\"'":
        return _quoted(text, at)
    if text[at] not in "[{":
        m = re.compile(r"(?:[^,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)*").match(text, at)
        return _plain(m[0]), m.end()
    close, found = {"[": "]", "{": "}"}[text[at]], {}
    at += 1
    while True:
        at += len(text[at:]) - len(text[at:].lstrip())
        if at >= len(text):
            raise ValueError("a bracket is not closed")
        if text[at] == close:
            return (found if close == "}" else None), at + 1
        key, at = _flow(text, at)
        at += len(text[at:]) - len(text[at:].lstrip())
        value = None
        if text[at : at + 1] == ":":
            value, at = ("", at + 1) if re.match(r":\s*[,}\]]", text[at:]) else _flow(text, at + 1)
            at += len(text[at:]) - len(text[at:].lstrip())
        if isinstance(key, str):
            found[key] = value if isinstance(value, str) and value else None
        if text[at : at + 1] == ",":
            at += 1
        elif text[at : at + 1] != close:
            raise ValueError("a comma is missing")


def _plain(text: str) -> str | None:
    """A plain scalar as Python writes its value; None for null."""
    text = text.strip()
    low = text.lower()
    if low in ("", "~", "null"):
        return None
    return {"true": "True", "yes": "True", "on": "True", "false": "False", "no": "False", "off": "False"}.get(low, text)


def _block(head: str, lines: list[str]) -> str:
    """A literal or folded scalar from its indented lines."""
    filled = [x for x in lines if x.strip()]
    depth = min((len(x) - len(x.lstrip(" ")) for x in filled), default=0)
    own = [x[depth:] for x in lines]
    text = "\n".join(own) if head[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(own))
    return text.rstrip("\n") if "-" in head else text.rstrip("\n") + "\n"


def _value(head: str, lines: list[str], anchors: dict[str, str | None]) -> str | None:
    """The value of a key from what stands behind it and the lines below it."""
    p = _PROPERTIES.match(head)
    name, head = (p["anchor"], head[p.end() :]) if p else (None, head)
    if re.fullmatch(r"[|>][-+0-9]*", head):
        found = _block(head, lines)
    else:
        rest = [_uncommented(x) for x in lines]
        text = "\n".join([head, *rest])
        if head[:1] in ("'", '"'):
            found, end = _quoted(text, 0)
            if text[end:].strip():
                raise ValueError("text behind a quote")
        elif head[:1] in ("[", "{"):
            _, end = _flow(text, 0)
            if text[end:].strip():
                raise ValueError("text behind a bracket")
            found = None
        elif head[:1] in ("@", "`", "%", "]", "}", ","):
            raise ValueError("no scalar begins so")
        elif head[:1] == "*":
            if head[1:].strip() not in anchors:
                raise ValueError("unknown alias")
            found = anchors[head[1:].strip()]
        else:
            below = [x.strip() for x in rest if x.strip()]
            if head and (": " in head or head.endswith(":")) or head and any(re.search(r":(\s|$)", x) for x in below):
                raise ValueError("a mapping within a scalar")
            nested = not head and below and (re.match(r"-(\s|$)|\?(\s|$)|[\[{]", below[0]) or re.search(r":(\s|$)", below[0]))
            if not head and below and below[0][0] in "\"'" and not nested:
                found = _quoted("\n".join(below), 0)[0]
            else:
                found = None if nested else _plain(" ".join([head, *below]))
    if name:
        anchors[name] = found
    return found


def top_level(text: str) -> dict[str, str | None] | None:
    """Keys of the top level and their values; None for what is no mapping."""
    lines = text.lstrip("﻿").splitlines()
    while lines and (not _uncommented(lines[0]).strip() or lines[0].startswith("%")):
        lines.pop(0)
    if lines and re.match(r"---(\s|$)", lines[0]):
        lines[0] = lines[0][3:].lstrip()
    ends = [i for i, x in enumerate(lines) if re.match(r"(\.\.\.|---)(\s|$)", x)]
    if ends and any(_uncommented(x).strip() for x in lines[ends[0] + 1 :]):
        raise ValueError("more than one document")
    lines = lines[: ends[0]] if ends else lines
    while lines and not _uncommented(lines[0]).strip():
        lines.pop(0)
    if not lines:
        return {}
    first = lines[0].lstrip(" ")
    if first[:1] == "\t":
        raise ValueError("a tab cannot indent")
    if first[0] in "[{":
        whole = "\n".join(map(_uncommented, lines))
        found, end = _flow(whole, 0)
        if whole[end:].strip():
            raise ValueError("text behind a bracket")
        return found if isinstance(found, dict) else None
    depth, out, anchors = len(lines[0]) - len(first), {}, {}
    if re.match(r"-(\s|$)", first):
        return None
    key = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#"'&*!|>%@`\[\]{},?-][^#]*?|[?-][^\s#][^#]*?|[^\s"'&*!|>%@`\[\]{},]*?))\s*:(?:\s+(.*))?$""")
    at = 0
    while at < len(lines):
        line = _uncommented(lines[at])
        if not line.strip():
            at += 1
            continue
        if len(line) - len(line.lstrip(" ")) != depth:
            raise ValueError("an indentation that fits nothing")
        m = key.match(line.strip())
        if not m:
            if out:
                raise ValueError("a line that is no entry")
            return None  # a scalar
        upto = at + 1
        while upto < len(lines):
            below = lines[upto]
            deep = len(below) - len(below.lstrip(" "))
            blank = not _uncommented(below).strip()
            item = not m[4] and deep == depth and re.match(r"-(\s|$)", below.strip())
            if below[:1] == "\t" or below.lstrip(" ")[:1] == "\t" and not blank:
                raise ValueError("a tab cannot indent")
            if not (blank or deep > depth or item):
                if not m[4] or m[4][0] not in "\"'[{" or _closed("\n".join([m[4], *lines[at + 1 : upto]])):
                    break
            upto += 1
        name = _quoted(line.strip(), 0)[0] if m[3] is None else m[3].strip()
        out[name] = _value((m[4] or "").strip(), lines[at + 1 : upto], anchors)
        at = upto
    return out


def _closed(head: str) -> bool:
    try:
        _quoted(head, 0) if head[0] in "\"'" else _flow(head, 0)
    except ValueError:
        return False
    return True
