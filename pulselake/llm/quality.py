"""Line-first cleaning: rules per line, failed lines removed, documents that lose too much rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases that mark a line as boilerplate, in English, German, French and Spanish.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of service", "terms of use", "all rights reserved", "lorem ipsum", "enable javascript", "accept cookies", "accept all cookies", "skip to content", "back to top", "licensed under", "released under the",
    "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "nutzungsbedingungen", "cookies akzeptieren", "zum inhalt springen", "nach oben scrollen", "lizenziert unter", "veröffentlicht unter der",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions générales d'utilisation", "accepter les cookies", "aller au contenu", "haut de page", "sous licence", "publié sous la licence",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "términos y condiciones", "aceptar cookies", "saltar al contenido", "volver arriba", "con licencia", "publicado bajo la licencia",
)
#: Phrases that are a button's or a menu's if the line has few other words.
MENU = (
    "click here", "sign up", "log in", "subscribe now", "share this", "read more",
    "hier klicken", "jetzt anmelden", "registrieren", "weiterlesen", "teilen",
    "cliquez ici", "s'inscrire", "se connecter", "lire la suite", "partager",
    "haga clic aquí", "registrarse", "iniciar sesión", "leer más", "compartir",
)
#: What is no part of a word, in both engines alike.
BORDER = r"[^0-9A-Za-z_\x{C0}-\x{24F}]"


def phrase_pattern(phrases: tuple[str, ...], border: str) -> str:
    """Any of the phrases as whole words."""
    return f"(^|{border})({'|'.join(phrases)})($|{border})"


_PY_BORDER = "[^0-9A-Za-z_\u00c0-\u024f]"
_BOILER, _MENU = (re.compile(phrase_pattern(p, _PY_BORDER), re.I) for p in (BOILERPLATE, MENU))
#: Separators of navigation lines.
_NAV = re.compile(r"\s[|>»·•]\s")
_END = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$|[\"”»]$")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BRACES = re.compile(r"[{}]")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on the document."""

    menu_max_words: int = 4
    nav_separators: int = 3
    symbol_share: float = 0.10
    boilerplate_max_words: int = 25
    max_lost_share: float = 0.30


def line_fault(line: str, rules: LineRules = LineRules()) -> str | None:
    """Name of the rule that a line with words breaks, or None: phrases of boilerplate as whole words, menus, separators of navigation, a surplus of signs, no mark at the end."""
    text = line.strip()
    words = text.encode().split()
    if len(words) <= rules.boilerplate_max_words and _BOILER.search(text):
        return "boilerplate"
    if len(words) <= rules.menu_max_words and _MENU.search(text):
        return "menu"
    if len(_NAV.findall(text)) >= rules.nav_separators and 4 * len(_NAV.findall(text)) >= len(words):
        return "navigation"
    if len(_SYMBOLS.findall(text)) > rules.symbol_share * max(1, len(text)) or len(_BRACES.findall(text)) > 0.05 * len(text):
        return "symbols"
    if not _END.search(text):
        return "punctuation"
    return None


def profile(text: str | None, rules: LineRules = LineRules()) -> dict:
    """Counts, kept lines and verdict for one whole text (null: empty)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    seen: set[str] = set()
    dup = lost = total = n_lines = n_failed = 0
    kept = []
    for line in text.split("\n"):
        size = len(line.encode("utf-8", "surrogatepass").split())
        if not size:
            kept.append(line)
            continue
        n_lines += 1
        total += len(line)
        dup += line in seen
        seen.add(line)
        if line_fault(line, rules):
            lost += len(line)
            n_failed += 1
        else:
            kept.append(line)
    first: dict[tuple, int] = {}
    covered = bytearray(n)
    windows = zip(words, words[1:], words[2:])
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered[i] = covered[i + 1] = covered[i + 2] = covered[j] = covered[j + 1] = covered[j + 2] = 1
    repeat = sum(covered)
    failed = n < 50 or 100 * repeat > 50 * n
    return {
        "n_words": n, "word_chars": len(text) - sum(map(text.count, " \t\n\v\f\r")), "n_symbols": len(_SYMBOLS.findall(text)),
        "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed,
        "kept": not failed and lost <= rules.max_lost_share * total,
        "n_lines": n_lines, "n_failed_lines": n_failed, "lost_chars": lost, "clean_text": "\n".join(kept),
    }


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_failed_lines long, lost_chars long, clean_text string"
)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs``: its id, the counts and verdict of ``profile`` and the cleaned text.

    Null texts count as empty and fail the base rules; repeated rows and null ids pass through as they
    are; other columns of ``docs`` are ignored, so names cannot clash; an empty table gives an empty one.
    Row by row, without a shuffle.
    """
    ids = docs.select(id_col).schema[0]
    schema = f"{id_col} {ids.dataType.simpleString()}, {SCHEMA}"
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [profile(t, rules) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[c] for r in rows]) for c in names)], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
