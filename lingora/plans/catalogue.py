"""All queries over the reference's operators, by name."""

from lingora.plans import bundle, language, page, workflow

_ALL = {**language.QUERIES, **workflow.QUERIES, **page.QUERIES, **bundle.QUERIES}
_SQL = {**language.ORACLES, **workflow.ORACLES, **page.ORACLES, **bundle.ORACLES}
#: Those that show an operator on a few fixed rows: for tests, not for a registry of work on tables.
_FIXED = {
    "detect_language_fixture", "language_dimension", "chrome_locales", "protect_placeholders", "glossary_match", "glossary_compose", "glossary_enforce", "lcs_similarity", "nomenclature", "recognize_language",
}
FIXTURES = {k: v for k, v in _ALL.items() if k in _FIXED}
FIXTURE_ORACLES = {k: v for k, v in _SQL.items() if k in _FIXED}
QUERIES = {k: v for k, v in _ALL.items() if k not in _FIXED}
ORACLES = {k: v for k, v in _SQL.items() if k not in _FIXED}
