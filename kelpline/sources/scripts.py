"""SQL files of several statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: What a semicolon doesn't end: quoted text, quoted names and comments.
_PART = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", re.S)


def statements(text: str) -> list[str]:
    """The statements of a script, without comments."""
    out, current = [], []
    for part in _PART.findall(text):
        if part == ";":
            out.append("".join(current).strip())
            current = []
        elif not part.startswith(("--", "/*")):
            current.append(part)
    out.append("".join(current).strip())
    return [s for s in out if s]


def run_script(spark: SparkSession, path: str) -> list[DataFrame]:
    """Run a file's statements in order; the results of each."""
    with open(path, encoding="utf-8") as f:
        return [spark.sql(s) for s in statements(f.read())]
