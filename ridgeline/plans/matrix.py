"""The matrix of experiments: which runs to make, fuse, rerank and evaluate, as data; one session executes them all."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Run:
    method: str
    representation: str
    query_lang: str
    doc_lang: str
    k: int
    inputs: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return f"{self.method}__{self.representation}__q{self.query_lang}_d{self.doc_lang}"


FUSIONS = ("hybrid_rrf", "hybrid_score", "hybrid_union_candidates")


def distinct(values: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(values))


def matrix(
    query_langs: tuple[str, ...] = ("en", "es", "ca"), triple_langs: tuple[str, ...] = ("en", "es", "mix"), concat_langs: tuple[str, ...] = ("en", "es", "mix"), text_langs: tuple[str, ...] = ("en", "es"),
    hybrid_langs: tuple[str, ...] = ("en", "es", "mix"), mix_text_lang: str = "en", methods: tuple[str, ...] = ("bm25", "dense", "sparse"), top_k_base: int = 100, top_k_final: int = 10, fusion_depth: int | None = None,
) -> Iterator[Run]:
    """Base runs, their fusions per language of documents, multi-vector runs, and the cascade over the union.

    ``fusion_depth`` sets the depth of the base runs that fusions read; by default dense runs are deeper than the others.
    """
    texts = distinct([*text_langs, *([mix_text_lang] if "mix" in hybrid_langs else [])])
    for query_lang in query_langs:
        for method in methods:
            k = fusion_depth or (top_k_base if method == "dense" else top_k_final)
            for representation, langs in (("triples", triple_langs), ("text", texts), ("concat", concat_langs)):
                for lang in langs:
                    yield Run(method, representation, query_lang, lang, k)
            for lang in hybrid_langs:
                pair = (Run(method, "triples", query_lang, lang, k).name, Run(method, "text", query_lang, mix_text_lang if lang == "mix" else lang, k).name)
                for fusion in FUSIONS:
                    yield Run(method, fusion, query_lang, lang, top_k_base if "union" in fusion else top_k_final, pair)
        for representation, langs in (("triples", triple_langs), ("text", texts), ("concat", concat_langs)):
            for lang in langs:
                yield Run("multivector", representation, query_lang, lang, top_k_final)
        for lang in hybrid_langs:
            yield Run("multivector", "hybrid_cascade", query_lang, lang, top_k_final, (Run(methods[0], FUSIONS[2], query_lang, lang, top_k_base).name,))
