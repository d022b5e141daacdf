"""Types and fixed orders that every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

#: Severities in order, with their weight in a score.
SEVERITIES = ("low", "medium", "high", "critical")
WEIGHTS = (1, 3, 7, 15)
LOW, MEDIUM, HIGH, CRITICAL = range(4)
ALIASES = {"med": "medium", "crit": "critical"}

#: Where a string came from, and which of these are natural language.
PROVENANCES = (
    "Prose", "CodeFence", "Comment", "StringLiteral", "Docstring", "NotebookMarkdownCell", "NotebookCodeCell",
    "NotebookOutput", "HtmlText", "HtmlComment", "HtmlAttribute", "ConfigString", "PdfText", "Unknown",
)
NATURAL_LANGUAGE = ("Prose", "Docstring", "NotebookMarkdownCell", "HtmlText", "PdfText")

#: Detectors in the order in which their findings arrive, with their category.
DETECTORS = {
    "heuristic": "heuristic",
    "hidden_chars": "hidden_chars",
    "encoded": "encoded",
    "canary": "canary",
    "perplexity": "perplexity",
    "embedding": "embedding",
    "llm_classifier": "heuristic",
}

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("length", T.LongType())])
CHUNKS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("chunk_seq", T.IntegerType()),
        T.StructField("span", SPAN),
        T.StructField("text", T.StringType()),
        T.StructField("provenance", T.StringType()),
    ]
)
#: What a detector yields for a chunk, in an array.
HIT = "struct<detector:string,severity:int,confidence:double,start:bigint,end:bigint,message:string,evidence:string>"


def parse_severity(name: str) -> int:
    """Ordinal of a severity name, whatever its case."""
    low = name.strip().lower()
    return SEVERITIES.index(ALIASES.get(low, low))
