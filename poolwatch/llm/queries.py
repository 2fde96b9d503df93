"""The operators as registered queries, and the SQL of those that SQL can express."""

from poolwatch.llm import (
    benchmark, collocations, fingerprints, language, licenses, lines, mixing, near_copies, packing, pages, prefix_trie, quality, toxicity,
)

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_near_copies": near_copies.op2_near_copies,
    "op3_licenses": licenses.op3_licenses,
    "op4_packing": packing.op4_packing,
    "op5_language": language.op5_language,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pages": pages.op7_pages,
    "op8_quality": quality.op8_quality,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_mixing": mixing.op10_mixing,
    "op11_decontamination": benchmark.op11_decontamination,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_line_dedup": lines.ORACLE,
    "op2_near_copies": near_copies.ORACLE,
    "op3_licenses": licenses.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_decontamination": benchmark.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
