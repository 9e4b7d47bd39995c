"""Ordered patterns of protocol terms and of inputs, for both engines."""

from __future__ import annotations

# Name -> pattern, matched without regard to case; of an ordered list the first match counts.
HOSTS = {
    "cell_free": r"cell[- ]free|wheat germ|in vitro translation|PURE system",
    "insect": r"\bSf9\b|\bSf21\b|baculovir|High Five|insect cell",
    "mammalian": r"\bHEK ?293|\bCHO\b|mammalian cell",
    "yeast": r"\bPichia\b|\bS\. cerevisiae\b|yeast expression",
    "ecoli": r"\bBL21|\bE\.? ?coli\b|Rosetta|Origami|Tuner|C41|C43|Arctic ?Express|\bDE3\b|\bTOP10\b|\bJM109\b",
}
TAGS = {
    "his": r"his[- ]?tag|hexahistidine|polyhistidine|6 ?x ?his|his[- ]?6|his ?8|HHHHHH",
    "gst": r"\bGST\b|glutathione S-transferase",
    "mbp": r"\bMBP\b|maltose[- ]binding",
    "sumo": r"\bSUMO\b",
    "thioredoxin": r"thioredoxin|\bTrxA\b",
    "strep": r"strep[- ]?tag|streptavidin",
}
PROTEASES = {
    "tev": r"\bTEV\b|tobacco etch",
    "thrombin": r"\bthrombin\b",
    "prescission": r"pre ?scission|\bHRV ?3C\b|\b3C protease",
    "enterokinase": r"enterokinase|\bEK\b cleav",
    "sumo_protease": r"\bUlp1\b|SUMO protease",
}
FLAGS = {
    "selenomethionine": r"selenomet|\bSeMet\b|Se-Met",
    "autoinduction": r"auto[- ]?induc",
    "iptg": r"\bIPTG\b",
    "codon_optimised": r"codon[- ]optimi|codon usage engineered|synthetic gene|gene synthesis",
    "cold_shock": r"cold[- ]?shock|Arctic ?Express|\b1[0-8] ?°? ?C\b",
    "refolding": r"refold|inclusion bod",
    "detergent": r"\bDDM\b|detergent|\bLDAO\b|\bOG\b solubil|\bCHAPS\b",
}
# The published forms of protein accessions (with an isoform) and of structure codes (with a chain of one to four letters).
ACCESSION = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:-[0-9]+)?$"
STRUCTURE = r"^[1-9][A-Za-z0-9]{3}(?:[_.:-][A-Za-z0-9]{1,4})?$"
LETTERS = "ACDEFGHIKLMNPQRSTVWYBXZUO*"


def match(engine: str, column: str, pattern: str) -> str:
    """Spark's SQL is a template in which braces name frames, so those of a pattern are doubled there."""
    quoted = pattern.replace("'", "''")
    return f"{column} RLIKE r'{quoted.replace('{', '{{').replace('}', '}}')}'" if engine == "spark" else f"regexp_matches({column}, '{quoted}')"


def first_match(engine: str, column: str, patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {match(engine, column, '(?i)' + p)} THEN '{k}'" for k, p in patterns.items()) + " ELSE '' END"


def protocol_terms(engine: str, column: str) -> str:
    """SQL columns host, tag, protease and one boolean for each flag."""
    lists = [f"{first_match(engine, column, p)} AS {name}" for name, p in (("host", HOSTS), ("tag", TAGS), ("protease", PROTEASES))]
    return ", ".join(lists + [f"{match(engine, column, '(?i)' + p)} AS {k}" for k, p in FLAGS.items()])


def sniff(engine: str, column: str) -> str:
    """fasta, uniprot, pdb or null, by the shape of the input alone."""
    gone = f"upper({replace(engine, column, '[ 0-9.*-]', '')})"
    known = replace(engine, gone, "[^ACDEFGHIKLMNPQRSTVWYBXZUO*]", "")
    return (
        f"CASE WHEN {column} LIKE '>%' THEN 'fasta' WHEN {match(engine, f'upper({column})', ACCESSION)} THEN 'uniprot' WHEN {match(engine, column, STRUCTURE)} THEN 'pdb' "
        f"WHEN length({gone}) >= 20 AND length({known}) > CAST(0.9 AS DOUBLE) * length({gone}) THEN 'fasta' END"
    )


def replace(engine: str, column: str, pattern: str, by: str) -> str:
    if engine == "spark":
        return f"regexp_replace({column}, r'{pattern}', '{by}')"
    return f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
