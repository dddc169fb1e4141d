"""Shorter forms of texts by their type. Each type is a fold over a text's lines, run in Arrow batches; a text never leaves
its row, so nothing is shuffled."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a line says, in the forms that are kept as they are.
NO_ERRORS, NO_PROBLEMS, ALL_PASSED = "[No errors found]", "[No errors or warnings found]", "[All tests passed]"
_FRAMEWORKS = re.compile(r"node_modules|internal/|node:|<anonymous>|webpack|\.next/|turbopack|jest-|mocha|karma|angular[\\/]core|react-dom|zone\.js", re.I)
_IMPORT = re.compile(r"(import|export|from|require|use|using|package|#include)\b")
_COMMENT = re.compile(r"//|#|/\*|\*|<!--|--")
_SIGNATURE = re.compile(r"(?:(?:export|default|public|private|protected|internal|static|abstract|final|override|async|pub|virtual)\s+)*(?:function|class|interface|struct|enum|trait|impl|def|fn|func|module|namespace|type)\b|(?:(?:public|private|protected|static|async|override)\s+)+[\w<>\[\], ]+\(|[\w$]+\s*\([^;]*\)\s*(?::\s*[\w<>\[\]| ]+)?\s*\{$")
_NOT_SIGNATURE = re.compile(r"(?:if|for|while|switch|catch|return|else|do|try)\b")
_STRINGS = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|//.*$")


def minimal(text: str) -> str:
    """Blanks at line ends, empty lines beyond one in a row and lines of a lone star go."""
    text = re.sub(r"(?m)[ \t]+$", "", text)
    return re.sub(r"(?m)^[ \t]*\*[ \t]*\n", "", re.sub(r"\n{3,}", "\n\n", text)).strip()


def _depth(line: str) -> int:
    bare = _STRINGS.sub("", line)
    return bare.count("{") - bare.count("}")


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def source(text: str, hard: bool) -> str:
    """Bodies of braces are left out behind their signature; hard also drops comments and empty lines."""
    out, depth, body = [], 0, None  # body: the depth within which lines are skipped
    for line in text.split("\n"):
        t = line.strip()
        opens = _depth(t)
        if body is not None and not _IMPORT.match(t):
            depth += opens
            if depth < body:
                body = None
                if not hard:
                    out += [f"{_indent(line)}  // ... implementation", line]
            continue
        if _IMPORT.match(t):
            out.append(line)
        elif _COMMENT.match(t):
            out += [] if hard else [line]
        elif _SIGNATURE.match(t) and not _NOT_SIGNATURE.match(t):
            kind = re.search(r"\b(class|interface|struct|trait|impl|namespace|module|enum)\b", t)
            if opens > 0:
                depth += opens
                if not kind:
                    body = depth
            out.append(f"{_indent(line)}{t.split('{')[0].rstrip()} {{ ... }}" if hard and not kind else line)
        else:
            depth += opens
            if t or not hard:
                out.append(line)
    return "\n".join(out)


def build_log(text: str, hard: bool) -> str:
    """Errors, and if not hard warnings and result lines, without time stamps and each once."""
    stamp = re.compile(r"^(?:\[\d\d:\d\d:\d\d[^\]]*\]|\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*)\s*")
    wanted = r"(?i)\b(?:error|fatal|exception)\b" + ("" if hard else r"|\b(?:warning|warn)\b|^(?:BUILD|COMPILE|Finished|Successfully)|\d+\s+(?:error|warning)")
    lines = (stamp.sub("", t.strip()) for t in text.split("\n"))
    out = list(dict.fromkeys(t for t in lines if t and re.search(wanted, t)))
    return "\n".join(["=== Errors ===" if hard else "=== Errors & Warnings ===", *out]) if out else NO_ERRORS if hard else NO_PROBLEMS


def test_output(text: str, hard: bool) -> str:
    """Blocks from a failure to the next empty or passing line, five of them if hard, and the summary lines."""
    fails = re.compile("(?i)^(?:FAIL|\u2717|\u2718|\u2715|\u00d7|not ok)|AssertionError|Error:|Expected|Received")
    ends = re.compile("(?i)^(?:PASS|\u2713|ok |Test Suites:|Tests:)")
    sums = re.compile(r"(?i)^(?:Test Suites?:|Tests:|Snapshots:|Time:)|\d+\s+(?:passing|failing|passed|failed|skipped)")
    blocks, summary, inside = [], [], False
    for line in text.split("\n"):
        t = line.strip()
        if fails.search(t):
            blocks += [] if inside else [[]]
            blocks[-1].append(line)
            inside = True
        elif inside and t and not ends.match(t):
            blocks[-1].append(line)
        else:
            inside = False
            summary += [t] if sums.search(t) else []
    out = [f"=== Failures ({len(blocks)}) ===", *("\n".join(b) for b in (blocks[:5] if hard else blocks))] if blocks else []
    out += [f"... and {len(blocks) - 5} more failures"] if hard and len(blocks) > 5 else []
    out += ["", "=== Summary ===", *summary] if summary else []
    return "\n".join(out) or ALL_PASSED


def stack_trace(text: str, hard: bool) -> str:
    """Frames of frameworks are counted, not shown; hard shows each line once."""
    out, skipped = [], 0

    def flush():
        if skipped:
            out.append(f"    ... {skipped} framework frames")

    for line in text.split("\n"):
        t = line.strip()
        if t.startswith(("at ", 'File "')) and _FRAMEWORKS.search(t):
            skipped += 1
            continue
        flush()
        skipped = 0
        out.append(line)
    flush()
    return "\n".join(dict.fromkeys(out) if hard else out)


def json_data(text: str, hard: bool) -> str:
    """The shape of a value: first items with a count of the others, long strings cut, deep objects as their keys."""
    try:
        value = json.loads(text)
    except ValueError:
        return text

    def shown(v, depth: int) -> str:
        here, below = "  " * depth, "  " * (depth + 1)
        if isinstance(v, dict) and v:
            if hard and depth > 1:
                return f"{here}{{ {', '.join(v)} }}"
            most = 5 if hard else 15
            part = [f'{below}"{k}": {shown(x, depth + 1).lstrip() if isinstance(x, dict | list) else json.dumps(x, ensure_ascii=False)}' for k, x in list(v.items())[:most]]
            part += [f"{below}// ... {len(v) - most} more keys"] if len(v) > most else []
            return f"{here}{{\n" + ",\n".join(part) + f"\n{here}}}"
        if isinstance(v, list) and v:
            if len(v) == 1 or (len(v) <= 3 and not hard):
                return f"{here}[\n" + ",\n".join(shown(x, depth + 1) for x in v) + f"\n{here}]"
            rest = f"{len(v) - 1} more items" + (" (schema same as above)" if hard else "")
            return f"{here}[\n{shown(v[0], depth + 1)}{'' if hard else ','}\n{below}// ... {rest}\n{here}]"
        if isinstance(v, str) and len(v) > 100:
            return f'{here}"{v[:100]}... ({len(v)} chars)"'
        return here + (f'"{v}"' if isinstance(v, str) else json.dumps(v))

    return shown(value, 0)


def markdown(text: str, hard: bool) -> str:
    for old, new in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\(https?://[^)]*\)", "" if hard else r"\1"), (r"<[^>]+>", ""), (r"(?m)^[-*_]{3,}\s*$", "")):
        text = re.sub(old, new, text)
    if hard:
        for old, new in ((r"(?m)^#{3,}\s+", "## "), (r"\*{1,3}|_{1,3}", ""), (r"(?m)^```\w*\n?", ""), (r"(?m)^\s{4,}[-*+]", "  -")):
            text = re.sub(old, new, text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def diff(text: str, hard: bool) -> str:
    """Headers and changes; of unchanged lines the last two (one, if hard) before each of them and at the end."""
    most, out, held = (1 if hard else 2), [], []

    def flush():
        if len(held) > most:
            out.append(f"  ... {len(held) - most} unchanged lines")
        out.extend(held[-most:])
        held.clear()

    for line in text.split("\n"):
        if line.startswith(("diff ", "@@", "+", "-")):
            flush()
            out.append(line)
        else:
            held.append(line)
    flush()
    return "\n".join(out)


def _kind(value: str) -> str:
    if value.lower() in ("true", "false"):
        return "boolean"
    return "number" if re.fullmatch(r"-?\d+(?:\.\d+)?", value) else "empty" if not value else "list" if value[0] == "[" else "object" if value[0] == "{" else "string"


def config_file(text: str, hard: bool) -> str:
    """Sections, and keys with values cut at 80 characters; hard keeps keys and the kinds of their values."""
    out = []
    for line in text.split("\n"):
        t = line.strip()
        pair = re.match(r"(\w[\w.-]*)\s*[:=]\s*(.*)", t)
        if not t or _COMMENT.match(t) or t[0] == ";":
            out += [] if hard else [line]
        elif re.fullmatch(r"\[.*\]|[\w.]+:", t):
            out.append(line)
        elif pair:
            key, value = pair[1], pair[2].strip()
            value = f"{value[:80]}... ({len(value)} chars)" if len(value) > 80 and not hard else value
            out.append(f"{_indent(line)}{key}: <{_kind(value)}>" if hard else f"{_indent(line)}{key} = {value}")
        elif not hard:
            out.append(line)
    return (f"[Config structure \u2014 {len(out)} entries]\n" if hard else "") + "\n".join(out)


def plain_text(text: str, hard: bool) -> str:
    """Hard keeps the first sentence of each paragraph."""
    if not hard:
        return text
    return "\n\n".join(re.split(r"(?<=[.!?])\s", p.strip(), maxsplit=1)[0] for p in re.split(r"\n\s*\n", text) if p.strip())


FORMS = {f.__name__: f for f in (source, build_log, test_output, stack_trace, json_data, markdown, diff, config_file, plain_text)}
FORMS["source_code"] = FORMS.pop("source")


def compressed(text: str, kind: str, level: str) -> str:
    """level: minimal squeezes blanks only, moderate and aggressive go by the type."""
    if not text.strip():
        return ""
    text = minimal(text)
    return text if level == "minimal" else FORMS.get(kind, plain_text)(text, level == "aggressive")


def compress(text: Column, kind: Column, level: str) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, kinds in batches:
            yield pd.Series([None if t is None else compressed(t, k, level) for t, k in zip(texts, kinds, strict=True)])

    return run(text, kind)


def lengths(text: Column, kind: Column, levels: tuple[str, ...]) -> Column:
    """A struct of the lengths (in code points) of a text's forms by level. Texts are read one at a time and no form is kept or sent
    back, so a task holds a batch of texts and one form."""

    @F.arrow_udf(", ".join(f"{x} long" for x in levels))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, kinds in batches:
            sizes = [[] for _ in levels]
            for t, k in zip(texts, kinds, strict=True):
                t, k = t.as_py(), k.as_py()
                for out, level in zip(sizes, levels, strict=True):
                    out.append(None if t is None else len(compressed(t, k, level)))
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sizes], names=list(levels))

    return run(text, kind)
