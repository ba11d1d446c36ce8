"""Column expressions on text: hints, configuration keys, questions and line numbers."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents in the order they are tried, with their patterns; the default is Logic.
INTENTS = {
    "Location": ["where is", "which file", "find the", "where does", "location of", "file for"],
    "Impact": ["what calls", "who uses", "what breaks if", "callers of", "impact of changing", "dependents of"],
    "Trace": ["trace", "follow", "from request to", "end to end", "flow of", "request flow", "execution path"],
    "Relation": ["what injects", "what renders", "what does .* use", "depends on", "relationship between", "connected to"],
    "Discovery": ["list all", "show all", "what controllers", "what services", "what domains", "how many", "enumerate"],
    "Logic": ["how does", "what does", "explain", "walk me through", "describe", "how it works"],
}
# Parts of a key that make its value a secret; the value that is shown instead.
SECRET_PARTS, REDACTED = ["password", "secret", "token", "apikey", "api_key", "credential"], "[REDACTED]"
# Patterns of the entities of a question.
ENTITIES = {"symbol_names": r"[A-Z][a-z]+(?:[A-Z][a-z]+)*", "file_paths": r"/[\w/.-]+/", "http_methods": r"(?i)\b(?:GET|POST|PUT|DELETE|PATCH)\b", "literals": "\"[^\"]+\"|'[^']+'"}


def hint(hints: Column, key: str) -> Column:
    """The value of a key in `key:value|key:value`: the last one, with its later colons; null if absent."""
    found = F.filter(F.split(hints, r"\|"), lambda part: part.startswith(f"{key}:"))
    return F.substring(F.try_element_at(found, F.lit(-1)), len(key) + 2, 1 << 30)


def simple_name(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, ".", -1), "#", 1)


def fqn_base(fqn: Column) -> Column:
    """A method's name without its parameter list."""
    return F.substring_index(fqn, "(", 1)


def is_secret(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SECRET_PARTS))


def redacted(key: Column, value: Column) -> Column:
    return F.when(is_secret(key), F.lit(REDACTED)).otherwise(value)


def intent(question: Column) -> Column:
    low, chain = F.lower(F.coalesce(question, F.lit(""))), None
    for name, patterns in INTENTS.items():
        fits = low.rlike("|".join(patterns))
        chain = F.when(fits, name) if chain is None else chain.when(fits, name)
    return chain.otherwise("Logic")


def entities(question: Column) -> Column:
    """struct of arrays: symbol_names, file_paths, http_methods, literals (without their quotes)."""
    every = lambda kind: F.regexp_extract_all(question, F.lit(ENTITIES[kind]), F.lit(0))
    literals = F.transform(every("literals"), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.struct(*[(literals if kind == "literals" else every(kind)).alias(kind) for kind in ENTITIES])


def line_of(text: Column, part: Column) -> Column:
    """1 plus the line ends before a part's first place; 1 if it is absent."""
    at = F.instr(text, part)
    before = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def decapitalised(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def bean_name(class_name: Column) -> Column:
    """LoanService -> loanService."""
    return F.concat(decapitalised(F.regexp_replace(class_name, "Service$", "")), F.lit("Service"))


def visibility(modifiers: Column) -> Column:
    """Of a bit mask: private 2, protected 4, public 1, else package."""
    bit = lambda n: modifiers.bitwiseAND(F.lit(n)) != 0
    return F.when(bit(2), "private").when(bit(4), "protected").when(bit(1), "public").otherwise("package")


