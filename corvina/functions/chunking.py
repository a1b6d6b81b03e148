"""Chunks of parsed files and of raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvina.functions.batches import by_bytes
from corvina.functions.parsing import Parsed, Symbol, parse

#: Token estimates that part small, ordinary and large symbols, and bytes of prose that make a doc chunk.
SMALL, GROUP, LARGE, PROSE = 64, 512, 1024, 60
TYPES = ("class", "struct", "enum", "trait", "interface")


def tokens(text: str) -> int:
    return len(text) // 4


def blocks(lines: list[str], target: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Line ranges of about target lines; a cut moves to a blank line within three, the nearer and then the earlier one."""
    out, at = [], 0
    while at < len(lines):
        stop = min(at + target, len(lines))
        if stop < len(lines):
            near = [k for d in range(4) for k in (stop - d, stop + d) if at < k < len(lines) and not lines[k].strip()]
            stop = near[0] if near else stop
        out.append((at, stop))
        if stop >= len(lines):
            break
        at = max(stop - overlap, at + 1)
    return out


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a line end at the end of the text opens no further line."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def raw_chunks(path: str, text: str) -> list[dict]:
    """One chunk of a short text, overlapping blocks of a long one, none of a blank one; all named after the file."""
    if not text.strip():
        return []
    base, lines = path.rsplit("/", 1)[-1], lines_of(text)
    if tokens(text) <= GROUP:
        return [{"level": "file", "name": base, "start": 1, "end": max(len(lines), 1), "text": text}]
    target = max(len(lines) // max(tokens(text) // GROUP, 2), 1)
    overlap = min(max(target // 8, 1), 6)
    return [{"level": "block", "name": base, "start": a + 1, "end": b, "text": "\n".join(lines[a:b])} for a, b in blocks(lines, target, overlap)]


def grouped_name(names: list[str]) -> str:
    """The first four names of a group, and how many more members it has."""
    shown = [n for n in names if n][:4]
    return ", ".join(shown) + (f" +{len(names) - len(shown)}" if len(shown) < len(names) else "")


def file_chunks(path: str, text: str, parsed: Parsed) -> list[dict]:
    """A file chunk, a chunk for each type, one for each documented symbol, then the callables in order: split, alone or grouped."""
    base = path.rsplit("/", 1)[-1]
    head = lambda s: " > ".join(["# " + base, *([s.parent] if s.parent else []), s.name])
    first_line = lambda s: (lines_of(s.body) or [""])[0].rstrip()
    listed = "".join(f"- {s.name} ({s.kind})\n" for s in parsed.symbols)
    imports = "".join(f"{i}\n" for i in parsed.imports) or "(none)\n"
    out = [{"level": "file", "name": base, "start": 1, "end": max(len(lines_of(text)), 1), "text": f"# File: {base}\n# Imports:\n{imports}# Symbols:\n{listed}"}]
    callables = [s for s in parsed.symbols if s.kind in ("function", "method")]
    for s in parsed.symbols:
        if s.kind in TYPES:
            methods = [m.name for m in callables if m.parent == s.name]
            out.append({"level": "class", "name": s.name, "start": s.start, "end": s.end, "text": first_line(s) + (f"\n# methods: {', '.join(methods)}" if methods else "")})
    for s in parsed.symbols:
        if len(s.doc.encode()) >= PROSE:
            out.append({"level": "doc", "name": s.name, "start": s.doc_start, "end": s.start, "text": f"{head(s)}\n{s.doc}\n{first_line(s)}"})
    pending: list[tuple[Symbol, str]] = []

    def flush():
        if pending:
            members = [s for s, _ in pending]
            out.append({"level": "function", "name": grouped_name([s.name for s in members]), "start": members[0].start, "end": members[-1].end, "text": "\n\n".join(t for _, t in pending)})
            pending.clear()

    for s in callables:
        n, whole = tokens(s.body), f"{head(s)}\n{s.body}"
        if n < SMALL:
            pending.append((s, whole))
            if sum(tokens(t) for _, t in pending) >= GROUP:
                flush()
            continue
        flush()
        if n < LARGE:
            out.append({"level": "function", "name": s.name, "start": s.start, "end": s.end, "text": whole})
            continue
        inner = lines_of(s.body)
        for k, (a, b) in enumerate(blocks(inner, max(len(inner) // max(n // GROUP, 2), 1))):
            again = inner[0] + "\n" if k else ""
            out.append({"level": "block", "name": s.name, "start": s.start + a, "end": s.start + b - 1, "text": head(s) + "\n" + again + "\n".join(inner[a:b])})
    flush()
    return out


def chunked_files(files: DataFrame, parsed_languages: list[str]) -> DataFrame:
    """(file, ordinal, level, name, start, end, text) of (file, language, text); files are independent, so no shuffle."""
    import pyarrow as pa

    columns = {"file": pa.string(), "ordinal": pa.int32(), "level": pa.string(), "name": pa.string(), "start": pa.int32(), "end": pa.int32(), "text": pa.string()}

    def run(batches):
        for b in by_bytes(batches, "text"):
            rows = []
            for path, lang, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                got = file_chunks(path or "", text or "", parse(text or "", lang)) if lang in parsed_languages else raw_chunks(path or "", text or "")
                rows += [{"file": path, "ordinal": k} | c for k, c in enumerate(got)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in columns.items()], list(columns))

    return files.select("file", "language", "text").mapInArrow(run, "file string, ordinal int, level string, name string, start int, end int, text string")
