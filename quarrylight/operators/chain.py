"""All edges of companies from their texts, fields and tags, in one plan: mentions, bids, investments and downstream industries.

Companies are rows (own, text, bids, invests, segment, own_makes, downstream, scenes); ``own`` is not null, null texts, fields and lists
give no edges, and a company of several rows gets the edges of each. Edges have the columns of ``relations.EDGE``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import domain as D
from quarrylight.functions.exprs import in_both, is_missing
from quarrylight.operators import relations as R
from quarrylight.operators.tags import dedup_edges
from quarrylight.sources.io import saved


@dataclass
class Words:
    """What names companies and tells relations apart. ``kinds``: patterns of each kind of context, in order."""

    names: list[str] = field(default_factory=lambda: D.COMPANY)
    known: list[str] = field(default_factory=lambda: [n for _, names in D.COMPANY_INDUSTRIES for n in names])
    stop: list[str] = field(default_factory=list)
    nouns: list[str] = field(default_factory=list)
    kinds: list[tuple[str, list[str]]] = field(default_factory=lambda: [("客户", D.CUSTOMER_CONTEXT), ("供应商", D.SUPPLIER_CONTEXT), ("合作", D.PARTNER_CONTEXT), ("招投标", D.BIDDING_CONTEXT)])
    other: str = "合作"
    industries: list[tuple[str, str]] = field(default_factory=lambda: [(n, industry) for industry, names in D.COMPANY_INDUSTRIES for n in names])
    scenes: dict[str, str] = field(default_factory=lambda: D.CONTEXT_SCENES)
    bids: list[str] = field(default_factory=lambda: D.BIDDING_CONTEXT)
    company: str = D.ANY_COMPANY
    invests: list[str] = field(default_factory=lambda: D.INVESTMENT_CONTEXT)
    money: str = r"[\d,.]+\s*[亿万]元"
    own_industry: str = D.OWN_INDUSTRY

    def valid(self, name: Column, own: Column) -> Column:
        return R.valid_mention(name, own, self.stop, self.nouns)

    def industry(self, name: Column, context: Column) -> Column:
        """By the exact name, by containment either way in order, by a scene in the context; else ''. The words are literals, so the plan's size doesn't grow with them."""

        def first(words: list[tuple[str, str]], fits) -> Column:
            table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in words])
            return F.get(F.filter(table, lambda x: fits(x["k"])), F.lit(0))["v"]

        found = [first(list(dict(self.industries).items()), lambda k: k == name), first(self.industries, lambda k: in_both(name, k))] if self.industries else []
        found += [first(list(self.scenes.items()), lambda k: F.contains(context, k))] if self.scenes else []
        return F.coalesce(*found, F.lit(""))


def classified_mentions(companies: DataFrame, words: Words) -> DataFrame:
    """(own, own_makes, seq, name, context, snippet, kind, industry) of every valid name in a company's text."""
    rows = R.mentions(companies.select(F.struct("own", "own_makes").alias("of"), "text"), "of", "text", words.names, words.known)
    rows = rows.select("of.*", "seq", "name", "context", "snippet").where(words.valid(F.col("name"), F.col("own")))
    kind = F.lit(words.other)
    for label, patterns in reversed(words.kinds):
        kind = F.when(F.col("context").rlike("|".join(f"(?:{p})" for p in patterns)), label).otherwise(kind)
    return rows.withColumns({"kind": kind, "industry": words.industry(F.col("name"), F.col("context"))})


def company_edges(companies: DataFrame, words: Words | None = None) -> DataFrame:
    """The most confident edge of each subject, object and type; of those alike, the one of the first step."""
    words = words or Words()
    named = saved(classified_mentions(companies, words))
    steps = [
        R.context_edges(named, F.coalesce("own_makes", F.lit(False)), R.is_maker(F.col("name"))),
        R.bidding_edges(companies, "own", "bids", "text", words.names, words.bids, words.company, words.valid, words.industry),
        R.investment_edges(companies, "own", "invests", "text", "segment", words.invests, words.invests, words.money),
        R.downstream_edges(companies.select("own", "downstream", "scenes"), named.where(~is_missing(F.col("industry"))).select("own", "seq", "name", "industry"), words.scenes, words.own_industry),
    ]
    every = [s.select(*R.EDGE, F.lit(k).alias("step")) for k, s in enumerate(steps)]
    out = every[0]
    for s in every[1:]:
        out = out.unionByName(s)
    return dedup_edges(out, ["subject", "object", "rel_type"], "confidence", "step").drop("step")
