"""Query templates, natural-language dispatch, and suggestions."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words that the name of a database operation holds.
_DATABASE_WORDS = ("query", "select", "insert", "update", "delete", "find", "save")


@dataclass(frozen=True)
class Template:
    """A query with named parameters: IRIs, or numbers where the name ends in _threshold."""

    title: str
    text: str
    parameters: tuple[str, ...] = ()

    def fill(self, **values: object) -> str:
        out = self.text
        for name in self.parameters:
            if name not in values:
                raise ValueError(f"{self.title} needs {name}")
            value = str(int(values[name])) if name.endswith("_threshold") else f"<{_iri(str(values[name]))}>"
            out = out.replace(f"${name}$", value)
        return out


def _iri(text: str) -> str:
    if re.search(r'[<>"{}|^`\\\x00-\x20]', text):
        raise ValueError(f"not an IRI: {text!r}")
    return text


#: The templates' names, their parameters and the variables of their answers.  Each query stands for itself.
TEMPLATES = {
    "functions_calling_function": Template(
        "Functions calling a function",
        "SELECT ?caller ?callerName WHERE { ?caller code:calls $target_function$ ; code:hasName ?callerName }",
        ("target_function",),
    ),
    "functions_called_by_function": Template(
        "Functions called by a function",
        "SELECT ?callee ?calleeName WHERE { $source_function$ code:calls ?callee . ?callee code:hasName ?calleeName }",
        ("source_function",),
    ),
    "classes_implementing_interface": Template(
        "Classes implementing an interface",
        "SELECT ?class ?className WHERE { ?class code:implements $interface$ ; code:hasName ?className }",
        ("interface",),
    ),
    "functions_in_module": Template(
        "Functions in a module",
        "SELECT ?function ?functionName WHERE { $module$ code:defines ?function . ?function a code:Function ; code:hasName ?functionName }",
        ("module",),
    ),
    "variables_accessed_by_function": Template(
        "Variables accessed by a function",
        "SELECT ?variable ?varName WHERE { $function$ code:references ?variable . ?variable a code:Variable ; code:hasName ?varName }",
        ("function",),
    ),
    "call_chain_between_functions": Template(
        "Call chain between functions",
        "SELECT ?intermediate WHERE { $source_function$ code:calls+ ?intermediate . ?intermediate code:calls+ $target_function$ }",
        ("source_function", "target_function"),
    ),
    "circular_dependencies": Template(
        "Circular dependencies",
        "SELECT ?module1 ?module2 WHERE { ?module1 code:imports ?module2 . ?module2 code:imports+ ?module1 }",
    ),
    "database_operations": Template(
        "Database operations",
        "SELECT ?function ?functionName WHERE { ?function code:calls ?dbCall ; code:hasName ?functionName . ?dbCall code:hasName ?dbCallName FILTER("
        + " || ".join(f'CONTAINS(LCASE(?dbCallName), "{word}")' for word in _DATABASE_WORDS)
        + ") }",
    ),
    "unused_functions": Template(
        "Unused functions",
        "SELECT ?function ?functionName WHERE { ?function a code:Function ; code:hasName ?functionName ; code:isExported false MINUS { ?caller code:calls ?function } }",
    ),
    "high_complexity_functions": Template(
        "High complexity functions",
        "SELECT ?function ?functionName (COUNT(?call) AS ?callCount) WHERE { ?function a code:Function ; code:hasName ?functionName ; code:calls ?call } "
        "GROUP BY ?function ?functionName HAVING (COUNT(?call) > $complexity_threshold$) ORDER BY DESC(?callCount)",
        ("complexity_threshold",),
    ),
    "functions_with_many_parameters": Template(
        "Functions with many parameters",
        "SELECT ?function ?functionName (COUNT(?param) AS ?paramCount) WHERE { ?function a code:Function ; code:hasName ?functionName ; code:hasParameter ?param } "
        "GROUP BY ?function ?functionName HAVING (COUNT(?param) > $param_threshold$) ORDER BY DESC(?paramCount)",
        ("param_threshold",),
    ),
}


def _by_name(predicate: str, name: str, one: str, label: str) -> str:
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return f'SELECT DISTINCT ?{one} ?{label} WHERE {{ ?target code:hasName ?targetName . ?{one} code:{predicate} ?target ; code:hasName ?{label} FILTER(LCASE(?targetName) = "{quoted.lower()}") }}'


#: Sentences in order: what they match, the template they use, and how it is filled.
SENTENCES = (
    (re.compile(r"database|\bdb\b|\bsql\b", re.IGNORECASE), "database_operations", lambda m: TEMPLATES["database_operations"].fill()),
    (re.compile(r"functions?\b.*\bcall(?:s|ing)?\b.*?([\w$]+)\W*$", re.IGNORECASE), "functions_calling_function", lambda m: _by_name("calls", m[1], "caller", "callerName")),
    (re.compile(r"class(?:es)?\b.*\bimplement(?:s|ing)?\b.*?([\w$]+)\W*$", re.IGNORECASE), "classes_implementing_interface", lambda m: _by_name("implements", m[1], "class", "className")),
    (re.compile(r"unused", re.IGNORECASE), "unused_functions", lambda m: TEMPLATES["unused_functions"].fill()),
    (re.compile(r"circular|cycl", re.IGNORECASE), "circular_dependencies", lambda m: TEMPLATES["circular_dependencies"].fill()),
    (re.compile(r"complex", re.IGNORECASE), "high_complexity_functions", lambda m: TEMPLATES["high_complexity_functions"].fill(complexity_threshold=5)),
    (re.compile(r"many parameters", re.IGNORECASE), "functions_with_many_parameters", lambda m: TEMPLATES["functions_with_many_parameters"].fill(param_threshold=4)),
)
EXAMPLES = ("Find functions that perform database operations", "Find functions calling a function", "Find classes implementing an interface", "Find unused functions", "Find circular dependencies", "Find complex functions", "Find functions with many parameters")


def dispatch(sentence: str) -> tuple[str, str] | None:
    """(template name, query) of the first sentence pattern that matches."""
    for pattern, name, fill in SENTENCES:
        if m := pattern.search(sentence.strip()):
            return name, fill(m)
    return None


def suggestions(partial: str, most: int = 10) -> list[str]:
    """Titles and example sentences that contain ``partial``."""
    low = partial.lower()
    return [t for t in [*(x.title for x in TEMPLATES.values()), *EXAMPLES] if low in t.lower()][:most]
