"""Texts of scripts and single-file components, by a lexer.

A documented subset of the languages: strings, templates with interpolations, comments, regular expressions after
operators, element texts in .jsx and .tsx, and the three blocks of a component. Types, decorators and unusual syntax
pass through as punctuation and names, which is enough to find strings; a file that does not close its strings has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SEGMENTS = "path string, seg_idx int, text string, start int, end int, line int, column int, context string, node_type string"
# What makes a string look like code (the last two on the raw text alone).
CODE_LIKE = [
    re.compile(r"</?[a-z][\s\S]*>", re.I), re.compile(r"\b(?:const|let|var|function|return|import|export|class|interface|type)\b"), re.compile(r"=>|;|https?://|\\\$\{|\{\{|\}\}"),
    re.compile(r"^[\s{\[]*[\"'][\w-]+[\"']\s*:"), re.compile(r"[{}][\s\S]*[;=,]"),
]
# Attributes of a component's template that hold no text.
SKIPPED = re.compile(r"class|style|id|key|ref|data-.*|aria-.*")

_TOKEN = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>'(?:\\[\s\S]|[^'\\\n])*'|"(?:\\[\s\S]|[^"\\\n])*")|(?P<tick>`)|(?P<name>[\w$]+)|(?P<mark>[\s\S])""")
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def cooked(raw: str) -> str:
    """A string's value from its source."""
    unit = lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else "" if m[4] == "\n" else _ESCAPES.get(m[4], m[4])
    return re.sub(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([\s\S]))", unit, raw)


def code_like(raw: str, value: str) -> bool:
    first, second, *rest = CODE_LIKE
    return bool(first.search(raw) or second.search(value or raw) or any(p.search(raw) for p in rest))


def _template(code: str, at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Quasis and interpolations (start, end) of a template that begins at a backtick, and where it ends; -1 if it does not."""
    quasis, holes, start, i = [], [], at + 1, at + 1
    while i < len(code):
        if code[i] == "\\":
            i += 2
        elif code[i] == "`":
            return [*quasis, (start, i)], holes, i + 1
        elif code.startswith("${", i):
            quasis.append((start, i))
            depth, j = 1, i + 2
            while j < len(code) and depth:
                m = _TOKEN.match(code, j)
                if m["tick"]:
                    _, _, j = _template(code, j)
                    if j < 0:
                        return [], [], -1
                    continue
                depth += (m[0] == "{") - (m[0] == "}")
                j = m.end()
            if depth:
                return [], [], -1
            holes.append((i + 2, j - 1))
            start = i = j
        else:
            i += 1
    return [], [], -1


def script_strings(code: str, jsx: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, text, node type) of the strings of a script that are not keys, module names or directives."""
    out, i, before, brackets, statement = [], 0, "", [], True

    def keep(a: int, b: int, kind: str, trim: bool) -> None:
        raw = code[a:b]
        value = cooked(raw)
        if code_like(raw, value):
            return
        if trim:
            left, right = len(raw) - len(raw.lstrip()), len(raw) - len(raw.rstrip())
            if left < len(raw):
                out.append((a + left, b - right, value.strip(), kind))
        else:
            out.append((a, b, value, kind))

    while i < len(code):
        m = _TOKEN.match(code, i)
        kind, text, i = m.lastgroup, m[0], m.end()
        if kind in ("space", "comment"):
            continue
        if kind == "string":
            rest = code[i:].lstrip()
            key = rest.startswith(":") and before in ("{", ",") and (brackets or [""])[-1] == "{"
            module = before in ("from", "import") or (before == "(" and re.search(r"\bimport\s*\(\s*\Z", code[: m.start()]))
            directive = statement and (not rest or rest[0] in ";}" or "\n" in code[i : len(code) - len(rest)])
            if not (key or module or directive):
                attribute = jsx and before == "=" and re.search(r"<[\w.]+(?:\s[^<>]*)?=\s*\Z", code[: m.start()])
                keep(m.start() + 1, i - 1, "JSXStringLiteral" if attribute else "StringLiteral", False)
        elif kind == "tick":
            quasis, holes, end = _template(code, m.start())
            if end < 0:
                return []
            for a, b in quasis:
                keep(a, b, "TemplateElement", True)
            for a, b in holes:
                out.extend((a + s, a + e, t, k) for s, e, t, k in script_strings(code[a:b], jsx))
            i = end
        elif text == "/" and (not before or before in "(,=:[!&|?{};+-*%<>~^" or before in ("return", "typeof", "case")) and (r := _REGEX.match(code, m.start())):
            i = r.end()
        elif text in "'\"":
            return []
        elif text in "([{":
            brackets.append(text)
        elif text in ")]}" and brackets:
            brackets.pop()
        elif jsx and text == ">" and before not in ("=", "-") and (t := re.compile(r"[^<>{}]+(?=[<{])").match(code, i)) and re.search(r"<(?:[\w.]+(?:\s[^<>]*)?|/[\w.]+|)\Z", code[: m.start()].rsplit(">", 1)[-1]):
            a, b = i, t.end()
            left, right = len(t[0]) - len(t[0].lstrip()), len(t[0]) - len(t[0].rstrip())
            if left < len(t[0]):
                out.append((a + left, b - right, t[0].strip(), "JSXText"))
            i = b
        before, statement = text, text in ";{}"
    return sorted(out)


class _Template(HTMLParser):
    """Text runs with their interpolations, static attributes and directive expressions of a component's template."""

    def __init__(self, source: str, base: int) -> None:
        super().__init__(convert_charrefs=False)
        self.source, self.base, self.found, self.run = source, base, [], None
        self.starts = [0]
        for m in re.finditer("\n", source):
            self.starts.append(m.end())

    def place(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def text(self, data: str) -> None:
        at = self.place()
        self.run = (self.run[0], at + len(data)) if self.run else (at, at + len(data))

    handle_data = text

    def handle_entityref(self, name):
        self.text(f"&{name};")

    def handle_charref(self, name):
        self.text(f"&#{name};")

    def flush(self) -> None:
        if self.run:
            raw = self.source[self.run[0] : self.run[1]]
            left, right = len(raw) - len(raw.lstrip()), len(raw) - len(raw.rstrip())
            if left < len(raw):
                self.found.append((self.base + self.run[0] + left, self.base + self.run[1] - right, raw.strip(), "template", "VueTemplateText"))
        self.run = None

    def handle_starttag(self, tag, attrs):
        self.flush()
        at, raw = self.place(), self.get_starttag_text()
        for m in re.finditer(r"""\s([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", raw):
            name, group = m[1], 2 if m[2] is not None else 3
            value, start = m[group], self.base + at + m.start(group)
            if name[0] in ":@#" or name.startswith("v-"):
                whole = re.fullmatch(r"""(['"])([\s\S]*)\1""", value)
                if whole and whole[2].strip():
                    self.found.append((start + 1, start + len(value) - 1, cooked(whole[2]), "template", "VueDirectiveStringLiteral"))
                for a, b, text, kind in script_strings(f"({value})"):
                    if not (whole and a == 2):
                        self.found.append((start + a - 1, start + b - 1, text, "template", f"VueDirective{kind}"))
            elif not SKIPPED.fullmatch(name) and value:
                self.found.append((start, start + len(value), value, "html-attr", "VueStaticAttribute"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.flush()

    def handle_comment(self, data):
        self.flush()


def component(code: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, text, context, node type) of a single-file component, in order of place."""
    out = []
    if m := re.search(r"<template(?:\s[^>]*)?>([\s\S]*)</template>", code):
        parser = _Template(m[1], m.start(1))
        parser.feed(m[1])
        parser.close()
        parser.flush()
        out += parser.found
    for m in re.finditer(r"<script(?:\s[^>]*)?>([\s\S]*?)</script>", code):
        out += [(m.start(1) + a, m.start(1) + b, t, "script", k) for a, b, t, k in script_strings(m[1])]
    for m in re.finditer(r"<style(?:\s[^>]*)?>([\s\S]*?)</style>", code):
        for s in re.finditer(r"""content:\s*(["'])((?:\\.|[^\\])*?)\1""", m[1]):
            out.append((m.start(1) + s.start(2), m.start(1) + s.end(2), s[2], "style", "CssContent"))
    return sorted(set(out))


def extract(path: str, code: str) -> list[tuple]:
    """Segments of one file, by its extension; none for others."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "vue":
        found = component(code)
    elif kind in ("js", "ts", "jsx", "tsx", "mjs", "cjs"):
        found = [(a, b, t, "script", k) for a, b, t, k in script_strings(code, kind in ("jsx", "tsx"))]
    else:
        return []
    seen, out = set(), []
    for a, b, text, context, node in found:
        if (a, b) not in seen and text.strip():
            seen.add((a, b))
            line = code.count("\n", 0, a) + 1
            out.append((path, len(out), text, a, b, line, a - (code.rfind("\n", 0, a) + 1) + 1, context, node))
    return out


def script_segments(files: DataFrame) -> DataFrame:
    """Segments of script and component files (path, content); a file is lexed whole in one Arrow batch row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [s for path, content in zip(frame.path, frame.content) for s in extract(path, content or "")]
            yield pd.DataFrame(rows, columns=["path", "seg_idx", "text", "start", "end", "line", "column", "context", "node_type"])

    return files.select("path", "content").mapInPandas(run, SEGMENTS)
