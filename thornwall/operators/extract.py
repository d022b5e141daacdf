"""From files to the strings that people or models read, with where they came from."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, file_name
from .lexers import LANGUAGES, source_spans

#: File names and extensions, and how they are read.
NAMED = {"Cargo.lock": "toml", "package-lock.json": "json", "composer.lock": "json", "bun.lockb": "json"}
EXTENSIONS = {"ipynb": "notebook", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "html": "markup", "htm": "markup", "svg": "markup", "xml": "markup", "pdf": "pdf"}
CONFIG_EXTENSIONS = (
    "lock sum ps1 psm1 psd1 bat cmd pl pm php phtml phps lua r jl ex exs erl hrl swift kt kts scala sc sbt dart m mm cs csx fs fsi fsx hs lhs "
    "clj cljc cljs ml mli vb vbs pas pp asm s sql proto fbs thrift ini cfg conf properties tf tfvars hcl nix dockerfile containerfile mk mak gradle cmake"
).split()
CONFIG_NAMES = (
    "Dockerfile Containerfile Makefile makefile GNUmakefile CMakeLists.txt Rakefile Gemfile Procfile Vagrantfile Jenkinsfile Brewfile Podfile Cartfile "
    "Justfile justfile .env .envrc"
).split()
ATTRIBUTES = ("title", "alt", "aria-label", "placeholder", "content")
STRINGS = "path string, string_seq int, base bigint, text string, provenance string"


def extractor(path: Column) -> Column:
    """Which extractor reads a file: by name, then extension, then other names, else as text."""
    name, ext = file_name(path), extension(path)
    pick = F.element_at(F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv)), name)
    by_ext = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext)
    return (
        F.when(name.isin(*NAMED), pick)
        .when(ext.isin(*EXTENSIONS), by_ext)
        .when(ext.isin(*LANGUAGES), "source")
        .when(ext.isin(*CONFIG_EXTENSIONS) | name.isin(*CONFIG_NAMES), "config")
        .otherwise("text")
    )


def whole(files: DataFrame) -> DataFrame:
    """Text and configuration files as one string each; those with NUL bytes or that aren't UTF-8 give none."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.select("path", F.lit(0).alias("string_seq"), F.lit(0).cast("bigint").alias("base"), text.alias("text"), F.when(F.col("extractor") == "text", "Prose").otherwise("ConfigString").alias("provenance"))
    return rows.where(F.col("text").isNotNull() & ~F.contains("text", F.lit("\0")))


def values(tree: Any) -> Iterator[str]:
    """Non-empty string values of a tree, in order; keys don't count."""
    if isinstance(tree, str):
        if tree:
            yield tree
    elif isinstance(tree, dict):
        for v in tree.values():
            yield from values(v)
    elif isinstance(tree, list | tuple):
        for v in tree:
            yield from values(v)


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    return dict(pairs)


def json_strings(data: bytes) -> Iterator[tuple[str, str, int]]:
    for s in values(json.loads(data.decode("utf-8"), object_pairs_hook=_unique, parse_constant=_refuse)):
        yield "ConfigString", s, 0


def _refuse(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def toml_strings(data: bytes) -> Iterator[tuple[str, str, int]]:
    for s in values(tomllib.loads(data.decode("utf-8"))):
        yield "ConfigString", s, 0


def yaml_strings(data: bytes) -> Iterator[tuple[str, str, int]]:
    """One document; values with a tag of their own don't count."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("!", lambda loader, suffix, node: None)
    for kind in ("timestamp", "binary"):
        Loader.add_constructor(f"tag:yaml.org,2002:{kind}", lambda loader, node: loader.construct_scalar(node))
    for s in values(yaml.load(data.decode("utf-8"), Loader)):
        yield "ConfigString", s, 0


CELLS = {"markdown": "NotebookMarkdownCell", "code": "NotebookCodeCell"}


def _joined(value: Any) -> str:
    """A string, or the strings of a list one after another; any other value is none."""
    if isinstance(value, str):
        return value
    return "".join(value) if isinstance(value, list) and all(isinstance(x, str) for x in value) else ""


def notebook_strings(data: bytes) -> Iterator[tuple[str, str, int]]:
    """Cells and their text outputs; a cell without a type makes the whole file unreadable."""
    cells = json.loads(data.decode("utf-8")).get("cells", [])
    found = []
    for cell in cells:
        found.append((CELLS.get(cell["cell_type"], "Unknown"), _joined(cell.get("source"))))
        for output in cell.get("outputs", []):
            shown = output.get("data") or {}
            found.append(("NotebookOutput", _joined(output.get("text"))))
            found += [("NotebookOutput", shown[k]) for k in ("text/plain", "text/markdown") if isinstance(shown, dict) and isinstance(shown.get(k), str)]
    for provenance, text in found:
        if text:
            yield provenance, text, 0


class _Markup(HTMLParser):
    """Texts, comments and chosen attributes in document order; script and style bodies are text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        if text := "".join(self.text).strip():
            self.found.append(("HtmlText", text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        self.found += [("HtmlAttribute", value) for name, value in dict(reversed(attrs)).items() if name.lower() in ATTRIBUTES and value]

    def handle_endtag(self, tag: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()
        if text := data.strip():
            self.found.append(("HtmlComment", text))

    def handle_pi(self, data: str) -> None:
        self.handle_comment("?" + data)

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def unknown_decl(self, data: str) -> None:
        self.handle_comment(f"[{data}]")


def markup_strings(data: bytes) -> Iterator[tuple[str, str, int]]:
    parser = _Markup()
    parser.feed(data.decode("utf-8"))
    parser.close()
    parser.flush()
    for provenance, text in parser.found:
        yield provenance, text, 0


def source_strings(data: bytes, ext: str) -> Iterator[tuple[str, str, int]]:
    text = data.decode("utf-8")
    plain, at, size = text.isascii(), 0, 0
    for kind, start, end in source_spans(text, ext):
        size += start - at if plain else len(text[at:start].encode())
        at = start
        yield kind, text[start:end], size


def pdf_strings(data: bytes) -> Iterator[tuple[str, str, int]]:
    """All text of a PDF, if a PDF library is installed; else nothing."""
    try:
        import io

        import pypdf
    except ImportError:
        return
    if text := "\n".join(page.extract_text() for page in pypdf.PdfReader(io.BytesIO(data)).pages):
        yield "PdfText", text, 0


READERS = {"json": json_strings, "toml": toml_strings, "yaml": yaml_strings, "notebook": notebook_strings, "markup": markup_strings, "pdf": pdf_strings}


def read(kind: str, path: str, data: bytes) -> list[tuple[str, str, int]]:
    """Strings of a structured file; one that can't be read gives none."""
    try:
        if kind == "source":
            return list(source_strings(data, path.rpartition(".")[2].lower()))
        return list(READERS[kind](data))
    except Exception:  # noqa: BLE001  a broken file is no reason to end a scan
        return []


def structured(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, i, base, text, provenance)
                for path, data, kind in zip(batch.path, batch.content, batch.extractor, strict=True)
                for i, (provenance, text, base) in enumerate(read(kind, path, bytes(data)))
            ]
            yield pd.DataFrame(rows, columns=["path", "string_seq", "base", "text", "provenance"])

    return files.select("path", "content", "extractor").mapInPandas(run, STRINGS)


def extract(files: DataFrame) -> DataFrame:
    """path, string_seq, base, text and provenance of every string; base is where it starts in the file, if known."""
    kinds = files.withColumn("extractor", extractor(F.col("path")))
    simple = F.col("extractor").isin("text", "config")
    return whole(kinds.where(simple)).unionByName(structured(kinds.where(~simple)))
