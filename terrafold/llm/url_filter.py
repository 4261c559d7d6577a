"""URL filter: a weighted vocabulary matched by Aho-Corasick, behind host and path rules."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches

# The vocabulary by weight, in several languages, without accents, as URLs mostly have words. A strict term
# rejects a URL alone; soft ones are telling or common words.
STRICT = (
    "porn porno pornography xxx hentai escort camgirl sexcam sextape milf nsfw casino sportsbook viagra cialis levitra kamagra tramadol "
    "malware spyware ransomware phishing botnet warez keygen spam spambot doorway cloaking "
    "pornografie pornofilm hurenforum fickfilm pornographie pornographique pornografia pornografico pornofilme putas prostitutas xvideo"
).split()
TELLING = (
    "adult sex sexy erotic erotica nude naked fetish webcam hookup bet betting gamble gambling poker slot roulette blackjack bookmaker lottery jackpot "
    "pill pharma pharmacy steroid weightloss loan payday forex crypto ad advert banner popup tracker affiliate clickbait torrent crack hack cheat pirate "
    "backlink linkfarm "
    "erotik nackt nackte sexshop gluecksspiel spielautomat sportwetten wette wetten lotterie potenzmittel abnehmen kredit sofortkredit raubkopie "
    "erotique nue sexe rencontre pari paris-sportifs loterie machine-a-sous credit pret regime-minceur piratage "
    "erotico erotica desnuda desnudo sexo contactos apuesta apuestas tragamonedas ruleta loteria prestamo credito adelgazar pirateria "
    "scommesse lotto prestito nuda sesso aposta apostas cassino emprestimo nudo gokken gokkast lening naakt"
).split()
COMMON = (
    "free cheap win winner bonus deal discount offer prize dating girl hot click track redirect promo farm buy online fast cash money earn rich secret "
    "gratis kostenlos billig gewinn gewinnspiel rabatt angebot preis geld verdienen reich geheim heiss kaufen schnell "
    "gratuit gagner gagnant remise cadeau argent riche acheter rapide "
    "gratuito barato ganar ganador descuento oferta premio dinero rico secreto comprar rapido "
    "vincere sconto soldi guadagnare comprare ganhar dinheiro korting winnen geld"
).split()
#: Weight of each term, and the weight of a URL's distinct terms that rejects it: one strict term, a telling one with any
#: other, or three common ones. A plural in s counts as its term.
VOCABULARY = dict.fromkeys(COMMON, 40) | dict.fromkeys(TELLING, 60) | dict.fromkeys(STRICT, 100)
LIMIT = 100
#: Terms that a vocabulary given as a table may have at most; more are an error.
MAX_TERMS = 1_000_000

ESCAPE = re.compile("%([0-9a-f]{2})")

#: (action, host, path prefix); the longest that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def vocabulary_of(table: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, int]:
    """A vocabulary from a table; of a repeated term the largest weight holds, null and empty terms are none."""
    rows = table.where(F.col(term) != "").groupBy(F.lower(term).alias("t")).agg(F.max(weight).cast("int").alias("w")).where("w is not null").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a URL vocabulary may have {MAX_TERMS} terms")
    return {r["t"]: r["w"] for r in rows}


def automaton(vocabulary: Mapping[str, int]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for plural in ("s", ""):  # a term of its own wins over a plural
        for term, weight in vocabulary.items():
            found.add_word(term + plural, (len(term + plural), term, weight))
    if len(found):
        found.make_automaton()
    return found


def unescaped(url: str) -> str:
    """A lower-case URL with percent escapes of printable ASCII as characters, and others as spaces, which part words."""
    shown = lambda m: chr(c).lower() if 0x20 <= (c := int(m[1], 16)) < 0x7F else " "
    return ESCAPE.sub(shown, url) if "%" in url else url


def hits(matcher, url: str) -> tuple[int, int, int]:
    """Distinct strict and soft terms in a lower-case string, and their weight; a term counts only between non-alphanumerics."""
    seen = {}
    if len(matcher):
        for end, (n, term, weight) in matcher.iter(url):
            start = end - n
            if (start < 0 or not url[start].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
                seen[term] = weight
    strict = sum(w >= LIMIT for w in seen.values())
    return strict, len(seen) - strict, sum(seen.values())


def vocabulary_hits(vocabulary: Mapping[str, int] = VOCABULARY):
    """Arrow UDF: struct of the distinct strict and soft terms in a URL, and their weight."""

    @F.pandas_udf("n_strict int, n_soft int, weight long")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = automaton(vocabulary)
        for urls in parts:
            yield pd.DataFrame([hits(matcher, unescaped(u)) if u else (0, 0, 0) for u in urls], columns=["n_strict", "n_soft", "weight"]).astype({"n_strict": "int32", "n_soft": "int32", "weight": "int64"})

    return udf


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From after the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (host + path) that fits a URL, else null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        found = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(h + p)).otherwise(found)
    return found


def filter_urls(df: DataFrame, url: str = "url", vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add host, path, rule, n_strict, n_soft, weight and verdict to each row; the rows stay whole and in place (no shuffle).

    The vocabulary is matched over the whole lower-case URL, scheme, query and fragment too; percent escapes of
    printable ASCII are read as characters, others separate words. URLs without :// have an empty host and path, fit no rule and are judged by the vocabulary; null and empty ones
    have no hit and the verdict allow. Very long URLs are matched whole. Repeated rows are judged alike. Input columns of
    these names are replaced; others pass through. An empty table gives an empty table.
    """
    small_batches(df.sparkSession)
    taken = {"host", "path", "rule", "n_strict", "n_soft", "weight", "verdict"} - {url}
    out = df.drop(*taken).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "__hits": vocabulary_hits(vocabulary)(F.lower(url))})
    action: Mapping[str, str] = {h + p: a for a, h, p in rules}
    method = F.when(F.col("__hits.weight") >= limit, "block").otherwise("allow")
    by_rule = F.lit(None).cast("string")
    for name, act in action.items():
        by_rule = F.when(F.col("rule") == name, act).otherwise(by_rule)
    return out.withColumns({"n_strict": F.col("__hits.n_strict"), "n_soft": F.col("__hits.n_soft"), "weight": F.col("__hits.weight"), "verdict": F.coalesce(by_rule, method)}).drop("__hits")


ship(__name__)
