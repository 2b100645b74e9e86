"""Text from bytes of an encoding that isn't known."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodings that are tried in order, strictly; a byte order mark comes before them all.
CODE = ("utf-8", "cp1251", "utf-16")
REPORT = ("utf-8", "utf-16-le", "cp1251")
HELP = ("utf-8", "cp1251", "utf-16")
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def decode(content: bytes | None, encodings: tuple[str, ...] = CODE) -> tuple[str, str]:
    """The text and the encoding it was in. Bytes that no encoding takes are read as the first, with replacements."""
    content = content or b""
    for mark, encoding in MARKS:
        if content.startswith(mark):
            return content.decode(encoding, "replace"), encoding
    for encoding in encodings:
        if encoding.startswith("utf-16") and (len(content) % 2 or b"\0" not in content):
            continue
        try:
            return content.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return content.decode(encodings[0], "replace"), encodings[0]


def decoded(content: Column, encodings: tuple[str, ...] = CODE) -> Column:
    """A struct of text and encoding; line ends are as Python reads them."""

    @F.pandas_udf("text string, encoding string")
    def run(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(x, encodings) for x in parts], columns=["text", "encoding"])

    return run(content)


def lossy(content: Column) -> Column:
    """UTF-8 with replacements, in the JVM: what the plain file search reads."""
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    return F.decode(F.when(marked, F.substring(content, 4, 2**31 - 4)).otherwise(content), "UTF-8")
