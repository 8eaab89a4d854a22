"""Abbreviations after which a full stop does not end a sentence: 1 never, 2 only before digits."""

from __future__ import annotations

import re

# Short lists; longer ones are read from files with ``load``.
_LETTERS = "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z"
_LISTS = {
    "en": ("Adj Adm Adv Asst Bros Capt Cmdr Col Corp Dr Drs Gen Gov Hon Insp Lt Maj Messrs Mr Mrs Ms Prof Rep Rev Sen Sgt Sr St vs i.e e.g Jan Feb Mar Apr Aug Sep Sept Oct Nov Dec", "No Nos Art pp"),
    "de": ("Dr Prof Hr Fr Nr Abb Bd bzw ca d.h usw vgl z.B Mio Mrd St Str u.a", ""),
    "fr": ("M MM Mme Mlle Dr Pr St Ste art av chap env etc fig p.ex vol", ""),
    "es": ("Sr Sra Dr Dra Av Ud Uds pág ej art núm", ""),
    "it": ("Sig Dott Prof Ing Avv art", ""),
    "ru": ("г гг им проф рис стр тел ул", ""),
}


def builtin(lang: str) -> dict[str, int]:
    """The short list of a language, or of English where there is none."""
    never, numeric = _LISTS.get(lang, _LISTS["en"])
    return {p: 1 for p in (_LETTERS + " " + never).split()} | {p: 2 for p in numeric.split()}


def parse(lines: list[str]) -> dict[str, int]:
    """Lists in files: an entry a line, ``#`` comments, and a marker for entries that count only before digits."""
    out: dict[str, int] = {}
    for ln in lines:
        if not ln.strip() or ln.startswith("#"):
            continue
        m = re.match(r"(.*)\s+(#NUMERIC_ONLY#)", ln)
        out[(m[1] if m else ln).strip()] = 2 if m else 1
    return out


def load_folder(spark, path: str) -> dict[str, dict[str, int]]:
    """Lists of all languages from files ``<anything>.<language>`` in a folder that Spark can read."""
    rows = spark.read.text(f"{path.rstrip('/')}/*.*").selectExpr("_metadata.file_name as name", "value").collect()  # lists of words
    files: dict[str, list[str]] = {}
    for r in rows:
        files.setdefault(r.name.rsplit(".", 1)[1], []).append(r.value)
    return {lang: parse(lines) for lang, lines in files.items()}


def load(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return parse(f.read().splitlines())
