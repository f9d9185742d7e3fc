"""Indel similarity of short names against a fixed list of synonyms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical column names with their synonyms; the order decides ties.
COLUMN_SYNONYMS: dict[str, list[str]] = {
    "date": ["fecha", "dt", "date:", "date_col", "period", "periodo", "dia", "day"],
    "amount": ["amt", "monto", "value", "total", "sum", "importe", "valor"],
    "description": ["desc", "descripcion", "detail", "detalle", "notes", "nota", "concepto"],
    "quantity": ["qty", "cantidad", "units", "count", "pieces", "unidades", "cant"],
    "price": ["precio", "unit_price", "rate", "tarifa", "costo", "cost"],
    "customer": ["cliente", "client", "buyer", "account", "cuenta"],
    "product": ["producto", "item", "sku", "article", "articulo"],
    "revenue": ["ingreso", "sales", "ventas", "income", "ingresos"],
    "expense": ["gasto", "cost", "costo", "egreso", "gastos"],
    "balance": ["saldo", "remaining", "outstanding", "remanente"],
    "name": ["nombre", "nm", "nombre_completo", "full_name"],
    "id": ["codigo", "code", "identifier", "clave", "numero", "number", "no", "num"],
    "month": ["mes", "monthly", "mensual"],
    "year": ["año", "anio", "yearly", "anual"],
    "category": ["categoria", "cat", "type", "tipo", "clasificacion"],
    "status": ["estado", "estatus", "situacion"],
    "comments": ["comentarios", "observaciones", "remarks", "obs"],
}
FUZZY_THRESHOLD = 80.0

MATCH_TYPE = "canonical string, score double, exact boolean"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Similarity 0..100: twice the common subsequence over the summed lengths."""
    if not a and not b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def match_synonyms(threshold: float = FUZZY_THRESHOLD, synonyms: dict[str, list[str]] | None = None):
    """A vectorised function from a name to its canonical name, score and exactness.

    Give it distinct names: the list of synonyms is fixed, so the work is linear in the names.
    """
    entries = synonyms or COLUMN_SYNONYMS
    exact: dict[str, str] = {}
    for canonical, words in entries.items():
        for word in [canonical, *words]:
            exact.setdefault(word, canonical)
    pairs = [(canonical, word) for canonical, words in entries.items() for word in words]
    letters = sorted({ch for _, word in pairs for ch in word})
    word_counts = np.array([[word.count(ch) for ch in letters] for _, word in pairs], dtype=np.uint8)
    word_lengths = np.array([len(word) for _, word in pairs])

    def candidates(names: list[str]) -> dict[int, list[int]]:
        """Words that can reach the threshold, by name: lengths and common letters bound the ratio."""
        by_length: dict[int, list[int]] = {}
        for at, name in enumerate(names):
            by_length.setdefault(len(name), []).append(at)
        out: dict[int, list[int]] = {}
        for size, places in by_length.items():
            words = np.flatnonzero(200.0 * np.minimum(size, word_lengths) >= threshold * (size + word_lengths))
            if not size or not len(words):
                continue
            chars = np.array([names[at] for at in places], dtype=f"<U{size}").view(np.uint32).reshape(len(places), size)
            common = np.zeros((len(places), len(words)), dtype=np.uint8)
            for i, ch in enumerate(letters):
                have = (chars == ord(ch)).sum(axis=1, dtype=np.uint8)
                common += np.minimum(have[:, None], word_counts[None, words, i])
            enough = 200.0 * common >= threshold * (size + word_lengths[words])
            for row, word in zip(*np.nonzero(enough)):
                out.setdefault(places[row], []).append(int(words[word]))
        return out

    def best(name: str, allowed: list[int]) -> tuple[str | None, float | None, bool]:
        if name in exact:
            return exact[name], 100.0, True
        found, top = None, 0.0
        for i in allowed:
            canonical, word = pairs[i]
            score = indel_ratio(name, word)
            if score >= threshold and score > top:
                found, top = canonical, score
        return found, (top if found else None), False

    @F.pandas_udf(MATCH_TYPE)
    def udf(names: pd.Series) -> pd.DataFrame:
        texts = ["" if n is None else n for n in names]
        allowed = candidates(texts)
        return pd.DataFrame(
            [best(n, allowed.get(i, [])) for i, n in enumerate(texts)], columns=["canonical", "score", "exact"]
        )

    return udf


def canonical_or_self(name: Column, match: Column) -> Column:
    return F.coalesce(match["canonical"], name)
