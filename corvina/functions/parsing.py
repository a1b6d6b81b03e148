"""Symbols, imports, call edges and HTTP routes of source files.

Python is parsed by the standard library. For the other languages no grammar is at hand, so declarations and calls are
found by patterns: an approximation, which misses what a grammar would tell apart.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from corvina.functions.batches import by_bytes


@dataclass
class Symbol:
    """A definition: `body` is its text from its keyword on, `doc` the comments and decorators right above it, which begin at doc_start."""

    name: str
    kind: str
    start: int
    end: int
    parent: str = ""
    doc: str = ""
    doc_start: int = 0
    body: str = ""


@dataclass
class Parsed:
    """Symbols in the order of their places, whole import statements, and calls (source, target, line)."""

    symbols: list[Symbol] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    edges: list[tuple[str, str, int]] = field(default_factory=list)


def doc_above(lines: list[str], start: int, comment: re.Pattern, least: int = 1) -> tuple[str, int]:
    """The run of comment and decorator lines right above line `start` (from 1), and the line it begins at."""
    at = start
    while at > least and comment.match(lines[at - 2]):
        at -= 1
    return "\n".join(lines[at - 1 : start - 1]).strip(), at


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")


def _dotted(node: ast.expr) -> str:
    """The text of a receiver; names and members of names, which most are, need no printer."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return f"{_dotted(node.value)}.{node.attr}"
    return ast.unparse(node)


class _Python(ast.NodeVisitor):
    """Definitions and calls; `types` are the annotated names of the whole file, the first annotation of a name counts."""

    COMMENT = re.compile(r"\s*#")

    def __init__(self, text: str):
        self.out, self.lines, self.source = Parsed(), text.split("\n"), _LINE.findall(text)
        self.classes, self.functions, self.types, self.calls = [], [], {}, []

    def _segment(self, node) -> str:
        """As ast.get_source_segment, which would part the whole text into lines for each node."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.source[first].encode()[node.col_offset : node.end_col_offset].decode()
        return "".join((self.source[first].encode()[node.col_offset :].decode(), *self.source[first + 1 : last], self.source[last].encode()[: node.end_col_offset].decode()))

    def visit_Import(self, node):
        self.out.imports.append(self._segment(node))

    def visit_ImportFrom(self, node):
        if node.module != "__future__":
            self.visit_Import(node)

    def _symbol(self, node, kind):
        # Decorators stand above a definition; comments above decorators belong to no definition.
        above = min((d.lineno for d in node.decorator_list), default=0)
        doc, first = ("\n".join(self.lines[above - 1 : node.lineno - 1]).strip(), above) if above else doc_above(self.lines, node.lineno, self.COMMENT)
        self.out.symbols.append(Symbol(node.name, kind, node.lineno, node.end_lineno, self.classes[-1] if self.classes else "", doc, first, self._segment(node)))
        for d in node.decorator_list:
            self.visit(d)

    def visit_ClassDef(self, node):
        self._symbol(node, "class")
        self.classes.append(node.name)
        for child in (*node.bases, *node.keywords, *node.body):
            self.visit(child)
        self.classes.pop()

    def visit_FunctionDef(self, node):
        self._symbol(node, "method" if self.classes else "function")
        spec = node.args
        plain = [*spec.posonlyargs, *spec.args]
        for arg in [*plain[: len(plain) - len(spec.defaults)], *(a for a, d in zip(spec.kwonlyargs, spec.kw_defaults) if d is None)]:
            if isinstance(arg.annotation, ast.Name):
                self.types.setdefault(arg.arg, arg.annotation.id)
        self.functions.append(f"{self.classes[-1]}.{node.name}" if self.classes else node.name)
        self.visit(spec)
        for child in (*([node.returns] if node.returns else []), *node.body):
            self.visit(child)
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name) and isinstance(node.annotation, ast.Name):
            self.types.setdefault(node.target.id, node.annotation.id)
        self.generic_visit(node)

    def visit_Call(self, node):
        f = node.func
        if self.functions and isinstance(f, (ast.Name, ast.Attribute)):
            base = _dotted(f.value) if isinstance(f, ast.Attribute) else ""
            self.calls.append((f.end_lineno, self.functions[-1], base, f.attr if base else f.id, self.classes[-1] if self.classes else ""))
        self.generic_visit(node)

    def parsed(self) -> Parsed:
        self.out.edges = [(source, qualified(base, callee, owner, self.types), line) for line, source, base, callee, owner in sorted(self.calls, key=lambda c: c[0])]
        self.out.symbols.sort(key=lambda s: s.start)
        return self.out


def qualified(base: str, callee: str, owner: str, types: dict[str, str]) -> str:
    """The callee with its type, where the receiver tells it: the enclosing type, a type name, or a name of a declared type."""
    if base in ("self", "this", "cls", "super"):
        return f"{owner}.{callee}" if owner else callee
    if base[:1].isupper():
        return f"{base}.{callee}"
    key = base.removeprefix("self.").removeprefix("this.")
    return f"{types[key]}.{callee}" if key in types else callee


_MODIFIERS = r"(?:(?:export|default|public|private|protected|abstract|final|static|async|unsafe|override|synchronized|readonly|declare|const)\s+|pub(?:\([^)]*\))?\s+)*"
_CONTAINER = re.compile(rf"\s*{_MODIFIERS}(class|struct|enum|trait|interface|impl|mod)\b(?:\s*<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?([A-Za-z_]\w*)")
_GO_TYPE = re.compile(r"\s*type\s+([A-Za-z_]\w*)\s+\w")
_FUNCTION = re.compile(rf"\s*{_MODIFIERS}(?:function\*?|fn|func)\s+(\(\s*\w*\s*\*?[A-Za-z_]\w*[^)]*\)\s*)?([A-Za-z_]\w*)")
_METHOD = re.compile(rf"\s+{_MODIFIERS}(?:get\s+|set\s+)?(?:[\w<>\[\],.?]+\s+)?([A-Za-z_]\w*)\s*\([^;]*\)\s*(?::\s*[^{{]+|throws\s+[\w, .]+)?\{{")
_CALL = re.compile(r"(?:\b((?:(?:self|this)\.)?[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\??\.\s*|\b[A-Za-z_]\w*::)?\b([A-Za-z_]\w*)\s*\(")
_IMPORT = re.compile(rf"\s*(?:import\b|(?:pub\s+)?use\s)")
#: Words before a parenthesis that call nothing.
KEYWORDS = {"if", "for", "while", "switch", "match", "return", "catch", "function", "fn", "func", "super", "sizeof", "typeof", "await", "async", "else", "def", "class", "with", "in", "loop"}
#: How a language declares the type of a name, where that type is a plain one. JavaScript declares none.
_DECLARED = {
    "java": re.compile(r"\b(?P<type>[A-Z]\w*)\s+(?P<name>[a-z_]\w*)\s*(?=[=;,)])"),
    "typescript": re.compile(r"\b(?P<name>[A-Za-z_]\w*)\s*[?!]?\s*:\s*(?P<type>(?!(?:number|string|boolean|any|void|unknown|never|object|symbol)\b)[A-Za-z_]\w*)\b(?![<.\[(])"),
    "go": re.compile(r"(?:[(,]|^\s*(?:var\s)?)\s*(?P<name>[a-z_]\w*)\s+(?P<type>[A-Za-z_]\w*)\s*(?=[,)=]|$)"),
    "rust": re.compile(r"\b(?P<name>[a-z_]\w*)\s*:\s*(?P<type>[A-Z]\w*)\b(?![<:])"),
}
_DECLARED["tsx"] = _DECLARED["typescript"]
_NO_TYPES = {"return", "func", "package", "import", "type", "go", "defer", "range", "case", "else"}


def _statement(lines: list[str], at: int) -> tuple[str, int]:
    """An import statement that begins at a line, which may run on within brackets, and the line after it."""
    stop, depth = at, 0
    while stop < len(lines):
        depth += sum(map(lines[stop].count, "({")) - sum(map(lines[stop].count, ")}"))
        stop += 1
        if depth <= 0:
            break
    return "\n".join(lines[at:stop]).strip(), stop


def _by_patterns(text: str, language: str) -> Parsed:
    out, lines, types = Parsed(), text.split("\n"), {}
    comment = re.compile(r"\s*(?://(?!!)|/\*(?!!)|\*|#\[|@\w)")
    if declared := _DECLARED.get(language):
        for line in lines:
            for m in declared.finditer(line):
                if m["name"] not in _NO_TYPES:
                    types.setdefault(m["name"], m["type"])
    depth, open_types, open_functions, skip = 0, [], [], 0

    def opened(name, kind, n, parent):
        doc, first = doc_above(lines, n, comment)
        out.symbols.append(Symbol(name, kind, n, n, parent, doc, first))
        return out.symbols[-1]

    for n, line in enumerate(lines, 1):
        if n <= skip:
            continue
        if _IMPORT.match(line) and not open_functions:
            statement, skip = _statement(lines, n - 1)
            out.imports.append(statement)
            continue
        owner, start = (open_types[-1][1] if open_types else ""), 0
        if m := _CONTAINER.match(line) or _GO_TYPE.match(line):
            kind, name = (m[1], m[2]) if m.re is _CONTAINER else ("type", m[1])
            made = opened(name, "module" if kind == "mod" else kind, n, owner) if kind != "impl" else None
            # Structs, modules and Go's types hold no methods of their own.
            open_types.append((depth, name if kind in ("class", "interface", "enum", "impl", "trait") and (kind != "enum" or language == "java") else owner, made))
            start = len(line)
        elif (m := _FUNCTION.match(line)) or (open_types and (m := _METHOD.match(line)) and m[1] not in KEYWORDS | {"new"}):
            name, receiver = (m[2], m[1]) if m.re is _FUNCTION else (m[1], None)
            made = opened(name, "method" if owner or receiver or m.re is _METHOD else "function", n, owner)
            open_functions.append((depth, f"{owner}.{name}" if owner else name, made))
            start = m.end(2) + 1 if m.re is _FUNCTION else m.end(1) + 1
        if open_functions and not line.lstrip().startswith(("//", "*", "/*")):
            for m in _CALL.finditer(line, start):
                before = line[: m.start()].rstrip()
                if m[2] not in KEYWORDS and not before.endswith("new") and m[2] != "new":
                    out.edges.append((open_functions[-1][1], qualified(m[1] or "", m[2], owner, types), n))
        depth += line.count("{") - line.count("}")
        for held in (open_functions, open_types):
            while held and depth <= held[-1][0] and ("}" in line or line.rstrip().endswith(";")):
                if (made := held.pop()[2]) is not None:
                    made.end = n
    for s in out.symbols:
        s.body = "\n".join(lines[s.start - 1 : s.end]).lstrip()
    return out


def parse(text: str, language: str) -> Parsed:
    if language != "python":
        return _by_patterns(text, language)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return Parsed()
    visitor = _Python(text)
    visitor.visit(tree)
    return visitor.parsed()


VERBS = "get|post|put|patch|delete|head|options"
EXPRESS_VERBS = "get|post|put|delete|patch|all"
_PLAIN_STRING = r"[\"']([^\"']*)[\"']"
_STRING = r"[\"'`]([^\"'`]*)[\"'`]"


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


#: Words before a parenthesis that declare no method.
NO_METHODS = {"if", "for", "while", "switch", "catch", "return", "new", "synchronized", "function"}


def _next_name(text: str, at: int) -> str:
    """The name that is declared next: before a parenthesis, no annotation, no member, no keyword."""
    for m in re.compile(r"(\w+)\s*\(").finditer(text, at):
        if m[1] not in NO_METHODS and text[at : m.start()].rstrip()[-1:] not in ("@", "."):
            return m[1]
    return ""


def _owner(text: str, at: int) -> str:
    """The type that was declared last before a place."""
    found = ""
    for m in re.compile(r"(?:class|interface|enum)\s+(\w+)").finditer(text, 0, at):
        found = m[1]
    return found


def _join(prefix: str, path: str) -> str:
    return "/" + "/".join(p for p in (prefix.strip("/"), path.strip("/")) if p)


def frameworks(path: str, text: str) -> str:
    """Which framework's patterns a file is read with."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ext == "py":
        return "fastapi" if re.search(r"\bFastAPI\b|\bAPIRouter\b|\bfastapi\b", text) else "flask" if ".route(" in text else "fastapi"
    if ext in ("js", "mjs", "cjs", "jsx"):
        return "express"
    if ext in ("ts", "tsx", "mts", "cts"):
        return "nestjs" if "@Controller" in text else "angular" if re.search(r"\bRoutes\b|RouterModule", text) else "express"
    if ext == "java":
        return "quarkus" if re.search(r"javax\.ws\.rs|jakarta\.ws\.rs|@Path\b", text) else "spring"
    return "spring" if ext in ("kt", "kts") else ""


def routes(path: str, text: str) -> list[dict]:
    """Routes (framework, http_method, path, handler_symbol, handler_method, line) of one file."""
    kind = frameworks(path, text)
    out = []

    def add(method, where, at, handler, owner=""):
        out.append({"framework": kind, "http_method": method.upper(), "path": where, "handler_symbol": f"{owner}.{handler}" if owner and handler else handler, "handler_method": handler, "line": _line(text, at)})

    def python_handler(at):
        found = re.compile(r"\bdef\s+(\w+)").search(text, at)
        return found[1] if found else ""

    if kind == "fastapi":
        for m in re.finditer(rf"@(?:app|router)\.({VERBS})\s*\(\s*{_PLAIN_STRING}", text):
            add(m[1], m[2], m.start(), python_handler(m.end()))
    elif kind == "flask":
        for m in re.finditer(rf"@\w+\.route\s*\(\s*{_PLAIN_STRING}([^)]*)\)", text):
            listed = re.search(r"methods\s*=\s*\[([^\]]*)\]", m[2])
            for verb in (re.findall(r"[\"']([^\"']+)[\"']", listed[1]) if listed else []) or ["GET"]:
                add(verb, m[1], m.start(), python_handler(m.end()))
    elif kind == "express":
        # A handler is the name that follows the path, on whichever line, and nothing else.
        named = re.compile(r"\s*,\s*([A-Za-z_$][\w.$]*)\s*[),]")
        for m in re.finditer(rf"\b(?:app|router)\.({EXPRESS_VERBS})\s*\(\s*{_STRING}", text):
            owner, _, method = (found[1] if (found := named.match(text, m.end())) else "").rpartition(".")
            add(m[1], m[2], m.start(), method, owner)
    elif kind == "nestjs":
        top = re.search(rf"@Controller\(\s*(?:{_STRING})?", text)
        for m in re.finditer(rf"@({VERBS})\(\s*(?:{_STRING})?\s*\)", text, re.I):
            if m[1][0].isupper():
                add(m[1], _join((top[1] or "") if top else "", m[2] or ""), m.start(), _next_name(text, m.end()), _owner(text, m.start()))
    elif kind == "spring":
        top = re.search(rf"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?{_STRING}", text)
        for m in re.finditer(rf"@(Get|Post|Put|Patch|Delete)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?(?:{_STRING})?[^)]*\))?", text):
            add(m[1], _join(top[1] if top else "", m[2] or ""), m.start(), _next_name(text, m.end()), _owner(text, m.start()))
    elif kind == "quarkus":
        top = re.search(rf"@Path\(\s*{_STRING}\s*\)", text)
        for m in re.finditer(r"@(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", text):
            # The method's own path stands within 200 bytes after the verb.
            near = text[m.end() :].encode()[:200].decode("utf-8", "ignore")
            own = re.search(rf"@Path\(\s*{_STRING}\s*\)", near.split("{")[0])
            add(m[1], _join(top[1] if top else "", own[1] if own else ""), m.start(), _next_name(text, m.end() + (own.end() if own else 0)), _owner(text, m.start()))
    elif kind == "angular":
        for m in re.finditer(rf"\bpath\s*:\s*{_STRING}", text):
            add("", _join("", m[1]), m.start(), "")
    return out


def parsed_files(files: DataFrame) -> DataFrame:
    """(file, symbols, imports, edges) of (file, language, text)."""
    import pyarrow as pa

    symbol = pa.struct([(k, pa.int32() if k in ("start", "end", "doc_start") else pa.string()) for k in Symbol.__dataclass_fields__])
    edge = pa.struct([("source", pa.string()), ("target", pa.string()), ("line", pa.int32())])

    def run(batches):
        for b in by_bytes(batches, "text"):
            got = [parse(t or "", lang) for lang, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array([[vars(s) for s in g.symbols] for g in got], pa.list_(symbol)), pa.array([g.imports for g in got], pa.list_(pa.string()))]
            edges = pa.array([[{"source": x, "target": y, "line": n} for x, y, n in g.edges] for g in got], pa.list_(edge))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, edges], ["file", "symbols", "imports", "edges"])

    schema = "file string, symbols array<struct<name:string,kind:string,start:int,end:int,parent:string,doc:string,doc_start:int,body:string>>, imports array<string>, edges array<struct<source:string,target:string,line:int>>"
    return files.select("file", "language", "text").mapInArrow(run, schema)


def extracted_routes(files: DataFrame) -> DataFrame:
    """Routes of (file, text), a row for each."""
    import pyarrow as pa

    kinds = [pa.string()] * 6 + [pa.int32()]
    columns = ["file", "framework", "http_method", "path", "handler_symbol", "handler_method", "line"]

    def run(batches):
        for b in by_bytes(batches, "text"):
            rows = [{"file": p} | r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in routes(p or "", t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in zip(columns, kinds)], columns)

    return files.select("file", "text").mapInArrow(run, "file string, framework string, http_method string, path string, handler_symbol string, handler_method string, line int")
