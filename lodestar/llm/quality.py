"""Quality rules, line first: rules judge each line, failing lines go, then documents that lost too much text are rejected."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_texts, small_batches

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
#: Closing marks of sentences and quotes in Latin, Chinese and Japanese, Arabic and Urdu, Indic, Ethiopic, Armenian,
#: Khmer, Burmese and Tibetan writing.
TERMINAL = tuple(".!?…:;\"'»”’)]" "。！？：；」』】）．｡" "؟؛۔" "।॥" "።፧" "։" "។៕" "၊။" "།༎")
#: Scripts that put no blanks between words: three of their letters count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
LETTERS_A_WORD = 3
#: Lines that are links, and stock phrases, in English, French, Spanish and German; other languages keep the rules without words.
NAVIGATION_WORDS = (
    r"home|menu|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|next|previous|back to top|read more|share|subscribe|skip to content|site map|sitemap|faq|help|"  # en
    r"accueil|connexion|se connecter|s'inscrire|inscription|recherche|rechercher|contactez-nous|à propos|suivant|précédent|retour en haut|haut de page|lire la suite|partager|s'abonner|plan du site|aide|"  # fr
    r"inicio|menú|iniciar sesión|registrarse|buscar|contacto|acerca de|siguiente|anterior|volver arriba|leer más|compartir|suscribirse|mapa del sitio|ayuda|"  # es
    r"startseite|menü|anmelden|registrieren|suche|suchen|kontakt|über uns|weiter|zurück|nach oben|mehr lesen|weiterlesen|teilen|abonnieren|inhaltsverzeichnis|hilfe|impressum"  # de
)
NAVIGATION = re.compile(rf"(?i)^(?:{NAVIGATION_WORDS})$")
SEPARATORS = frozenset(("|", "»", "›", ">", "·", "•", "::", "/"))
BOILERPLATE_WORDS = (
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|uses cookies|accept (?:all )?cookies|enable javascript|lorem ipsum|click here|copyright [0-9]{4}|subscribe to our newsletter|"  # en
    r"tous droits réservés|politique de confidentialité|conditions d'utilisation|utilise des cookies|accepter (?:tous )?les cookies|cliquez ici|mentions légales|"  # fr
    r"todos los derechos reservados|política de privacidad|términos (?:de uso|y condiciones)|utiliza cookies|aceptar (?:todas )?las cookies|haga clic aquí|aviso legal|"  # es
    r"alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|verwendet cookies|(?:alle )?cookies akzeptieren|hier klicken|newsletter abonnieren"  # de
)
BOILERPLATE = re.compile(f"(?i){BOILERPLATE_WORDS}")
#: Words a line without a closing mark must have at least; share of letters in a line; separators that make a menu.
MIN_UNCLOSED_WORDS, MIN_LETTERS, MENU_SEPARATORS = 4, 0.5, 3
#: A document is rejected when it loses more than this share of its word characters.
MAX_LOST = 0.5


def repeated_words(words: list[str], n: int = 3) -> int:
    """Words that lie in an n-word window found twice or more, the first one included."""
    if len(words) <= n:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    windows = ids[: len(ids) - n + 1]
    for k in range(1, n):
        nxt = ids[k : len(ids) - n + 1 + k]
        windows = windows * len(codes) + nxt
        if k < n - 1:  # dense again, so that products stay within 64 bits
            windows = np.unique(windows, return_inverse=True)[1]
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[where] > 1)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + n, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def line_fails(line: str, words: list[str]) -> bool:
    """The line rules: too few letters or no closing mark on a short line (punctuation), menus (navigation), stock phrases (boilerplate)."""
    bare = line.strip(" \t\n\v\f\r")
    chars = sum(map(len, words))
    letters = sum(map(str.isalpha, bare)) if bare.isascii() else sum(c.isalpha() or unicodedata.category(c)[0] == "M" for c in bare)
    if letters < MIN_LETTERS * chars:
        return True
    if len(words) < MIN_UNCLOSED_WORDS and not bare.endswith(TERMINAL):
        unspaced = 0 if bare.isascii() else len(UNSPACED.findall(bare))
        if unspaced < LETTERS_A_WORD * MIN_UNCLOSED_WORDS:
            return True
    if NAVIGATION.match(bare) or sum(map(SEPARATORS.__contains__, words)) >= MENU_SEPARATORS:
        return True
    return BOILERPLATE.search(bare) is not None


def judge(text: str) -> tuple:
    lines, seen, kept_lines = text.split("\n"), set(), []
    n_dup = lost = 0
    words: list[str] = []
    for line in lines:
        own = WORD.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        n_dup += line in seen
        seen.add(line)
        words += own
        if line_fails(line, own):
            lost += sum(map(len, own))
        else:
            kept_lines.append(line)
    chars = sum(map(len, words))
    n_repeat = repeated_words(words)
    base_failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    return len(words), chars, sum(map(text.count, SYMBOLS)), n_dup, n_repeat, base_failed, not base_failed and lost <= MAX_LOST * chars, lost, "\n".join(kept_lines)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: statistics of the whole text, ``lost_chars`` (word characters in failing lines), ``clean_text``
    (the text without them) and the verdicts ``base_failed`` and ``kept``.

    A null text counts as empty: no words, so ``base_failed``. Repeated rows and null ids each keep their own row.
    Lines without a word are neither judged nor lost. An empty table gives an empty result.
    """
    return map_texts(docs, lambda: judge, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, clean_text string", id_col, text_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that ``clean_lines`` keeps, all columns as they are but the text, which has lost its failing lines.

    Null and empty texts are rejected, as they have no words. Repeated rows are judged alike and stay as often as they come; an empty table
    stays empty; other columns, whatever their names, are handed on.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("kept boolean, clean_text string")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        rows = [judge(t or "") for t in texts]
        return pd.DataFrame({"kept": [r[6] for r in rows], "clean_text": [r[8] for r in rows]})

    verdict = verdict.asNondeterministic()  # else the filter and each field would judge the text anew
    mark = "_verdict" + "_" * max(map(len, docs.columns))
    judged = docs.withColumn(mark, verdict(F.col(text_col))).where(F.col(mark)["kept"])
    return judged.select(*[F.col(mark)["clean_text"].alias(c) if c == text_col else F.col(c) for c in docs.columns])
