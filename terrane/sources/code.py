"""Java and Groovy source as rows: one for each type, method, constructor and field.

Only the nesting of brackets needs Python: a scanner that blanks comments and strings, pairs the brackets and cuts out
declarations, in Arrow batches and in time linear in the file. All that is read from heads and bodies afterwards is
Catalyst's work (see code_graph).

Defined results: a null or empty text has no rows; text without a type has none; unbalanced brackets end with the file;
of nested types only the outermost is read, as top-level types are what is indexed; constants of an enum are not fields.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CARRIED = "project_id string, path string, artifact_type string, language string, content_hash string"
DECLARATIONS = (
    f"{CARRIED}, package string, imports array<string>, what string, keyword string, owner string, name string, type string, param_names array<string>, param_types array<string>, "
    "modifiers array<string>, annotations array<string>, doc string, line long, end_line long, extends array<string>, implements array<string>, value string, body string, "
    "said array<struct<at:long,said:string>>"
)

QUOTED = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
BRACKET, EDGE = re.compile(r"[(){}\[\]]"), re.compile(r"[(\[{;\n]")
ANNOTATION = re.compile(r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?")
TYPE = re.compile(r"(?:^|\s)(class|@?interface|enum|trait)\s+(\w+)")
MODIFIER = re.compile(r"\s*\b(public|protected|private|static|final|abstract|synchronized|native|transient|volatile|default|strictfp|def)\b(?!\s*[=(])")
GENERIC = re.compile(r"<[^<>]*>")
GOES_ON = re.compile(r"\s*[{.,?&|+=:]")


def plain(names: str) -> list[str]:
    """Type names of a list, without type arguments."""
    while GENERIC.search(names):
        names = GENERIC.sub("", names)
    return [n.strip() for n in names.split(",") if n.strip()]


def parameters(inside: str) -> tuple[list[str], list[str]]:
    """Names and types of a parameter list; an untyped one has the type `def`."""
    words = [ANNOTATION.sub(" ", p).split("=")[0].replace("final ", " ").split() for p in plain(inside)]
    return [w[-1] for w in words if w], [" ".join(w[:-1]) or "def" for w in words if w]


class Scan:
    def __init__(self, text: str, soft: bool) -> None:
        blank = lambda m: re.sub(r"[^\n]", " ", m.group())
        self.code = QUOTED.sub(lambda m: blank(m) if m.group().startswith(("/*", "//")) else m.group(), text)
        self.mask = QUOTED.sub(lambda m: blank(m) if m.group().startswith(("/*", "//")) else m.group()[0] + blank(m)[1:-1] + m.group()[-1], text)
        self.docs = [(m.start(), m.group()) for m in QUOTED.finditer(text) if m.group().startswith("/**")]
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.soft, self.ends, opened = soft, {}, []
        for m in BRACKET.finditer(self.mask):
            if m.group() in "({[":
                opened.append(m.start())
            elif opened:
                self.ends[opened.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def doc(self, begin: int, first: int) -> str:
        """The last documentation comment between the end of the declaration before and this one."""
        k = bisect_right(self.docs, (first,)) - 1
        if k < 0 or self.docs[k][0] < begin:
            return ""
        stripped = [row.strip().lstrip("*").strip() for row in self.docs[k][1][3:-2].split("\n")]
        return "\n".join(row for row in stripped if row)

    def statements(self, lo: int, hi: int) -> list[dict]:
        """The non-empty lines of a body with their numbers; a line that ends within round or square brackets goes on with the next."""
        out, open_, begin = [], [], lo
        for m in re.compile(r"[(){}\[\]\n]").finditer(self.mask, lo, hi):
            if m.group() in "({[":
                open_.append(m.group())
            elif m.group() != "\n":
                open_[-1:] = []
            elif not open_ or open_[-1] == "{":
                out.append((begin, m.start()))
                begin = m.end()
        out.append((begin, hi))
        return [{"at": self.line(a + len(text) - len(text.lstrip())), "said": text.replace("\n", " ")} for a, b in out if (text := self.code[a:b]).strip()]

    def finished(self, begin: int, at: int) -> bool:
        """Whether a line's end also ends a Groovy declaration."""
        head = ANNOTATION.sub("", self.mask[begin:at]).strip()
        return bool(head) and head[-1] not in ",=+&|.(?:<" and not TYPE.search(head) and not GOES_ON.match(self.mask, at)

    def pieces(self, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """Begin, end of the head and end of each declaration, its block included."""
        begin = at = lo
        while (m := EDGE.search(self.mask, at, hi)) is not None:
            at, edge = m.start(), m.group()
            if edge in "([":
                at = self.ends.get(at, hi) + 1
            elif edge == "{":
                end = min(self.ends.get(at, hi), hi)
                yield begin, at, end
                begin = at = end + 1
            elif edge == ";" or self.soft and self.finished(begin, at):
                yield begin, at, at
                begin = at = at + 1
            else:
                at += 1
        yield begin, hi, hi

    def declared(self, begin: int, head_end: int, end: int) -> dict | None:
        """What a piece has in common, whatever it declares; `left` is its head without annotations and modifiers."""
        head = self.mask[begin:head_end]
        first = begin + len(head) - len(head.lstrip())
        notes = [self.code[begin + m.start() : begin + m.end()] for m in ANNOTATION.finditer(head)]
        left, modifiers = ANNOTATION.sub(lambda m: " " * len(m.group()), head), []
        while (m := MODIFIER.match(left)) is not None:
            modifiers.append(m.group(1))
            left = " " * m.end() + left[m.end() :]
        if not left.strip():
            return None
        return {"left": left, "modifiers": modifiers, "annotations": notes, "doc": self.doc(begin, first), "line": self.line(first), "end_line": self.line(end)}

    def types(self) -> Iterator[dict]:
        package = re.search(r"^\s*package\s+([\w.]+)", self.code, re.M)
        about = {"package": package.group(1) if package else "", "imports": re.findall(r"^\s*import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?)", self.code, re.M)}
        for begin, head_end, end in self.pieces(0, len(self.mask)):
            row = self.declared(begin, head_end, end)
            found = row and TYPE.search(row["left"])
            if not found:
                continue
            rest = row.pop("left")[found.end() :]
            up = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|$)", rest, re.S)
            faces = re.search(r"\bimplements\s+(.*)", rest, re.S)
            owner = f"{about['package']}.{found.group(2)}".lstrip(".")
            yield about | row | {
                "what": "type", "keyword": found.group(1).lstrip("@"), "owner": owner, "name": found.group(2), "extends": plain(up.group(1)) if up else [], "implements": plain(faces.group(1)) if faces else [],
            }
            for k, piece in enumerate(self.pieces(head_end + 1, end)):
                member = None if found.group(1) == "enum" and k == 0 else self.member(*piece, found.group(2))
                if member:
                    yield about | member | {"keyword": found.group(1).lstrip("@"), "owner": owner}

    def member(self, begin: int, head_end: int, end: int, of: str) -> dict | None:
        row = self.declared(begin, head_end, end)
        if row is None or TYPE.search(row["left"]):
            return None
        left = row.pop("left")
        sign, round_ = left.find("="), left.find("(")
        if round_ >= 0 and not 0 <= sign < round_:
            named = re.search(r"(.*?)(\w+)\s*$", left[:round_], re.S)
            if not named:
                return None
            close = self.ends.get(begin + round_, head_end)
            names, types = parameters(self.code[begin + round_ + 1 : close])
            kind = GENERIC.sub("", named.group(1)).strip() if named.group(1).strip().startswith("<") else named.group(1).strip()
            inside = (head_end + 1, end) if end > head_end else (end, end)
            what = "constructor" if named.group(2) == of and not kind else "method"
            return row | {"what": what, "name": named.group(2), "type": kind, "param_names": names, "param_types": types, "body": self.code[slice(*inside)], "said": self.statements(*inside)}
        both = left if sign < 0 else left[:sign]
        typed = re.match(r"\s*([\w.]+(?:\s*<.*>)?(?:\s*\[\s*\])*)\s+(\w.*)", both, re.S)
        words = re.findall(r"\w+", typed.group(2).split(",")[-1] if typed else both)
        if not words or not typed and not row["modifiers"]:
            return None
        value = self.code[begin + sign + 1 : end + (end > head_end)].strip() if sign >= 0 else ""
        closure = value.startswith("{")
        body = {"body": self.code[head_end + 1 : end], "said": self.statements(head_end + 1, end)} if closure else {}
        return row | {"what": "field", "name": words[0], "type": re.sub(r"\s+", "", typed.group(1)) if typed else "", "value": value} | body


def declarations(files: DataFrame) -> DataFrame:
    """Rows of DECLARATIONS from files (CARRIED and text)."""
    carried = [c.split()[0] for c in CARRIED.split(", ")]
    columns = [c.split()[0] for c in DECLARATIONS.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                rows = []
                for file in pdf.iloc[at : at + 256].itertuples(index=False):
                    about = {c: getattr(file, c) for c in carried}
                    rows += [about | row for row in Scan(file.text or "", file.language == "groovy").types()]
                yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)

    return files.select(*carried, "text").mapInPandas(scan, DECLARATIONS)
