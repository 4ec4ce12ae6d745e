"""The queries of this subpackage and their DuckDB SQL."""

from . import ann, infill, jaccard, licenses, mixing, parsing, periods, pieces, quality, secrets, sharding, substrings, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_quality": quality.op3_quality,
    "op4_substrings": substrings.op4_substrings,
    "op5_mixing": mixing.op5_mixing,
    "op6_pieces": pieces.op6_pieces,
    "op7_licenses": licenses.op7_licenses,
    "op8_warc": warc.op8_warc,
    "op9_secrets": secrets.op9_secrets,
    "op10_ann": ann.op10_ann,
    "op11_periods": periods.op11_periods,
    "op12_parsing": parsing.op12_parsing,
    "op13_infill": infill.op13_infill,
}

ORACLES = {
    "op3_quality": quality.ORACLE_OP3,
    "op5_mixing": mixing.ORACLE_OP5,
    "op7_licenses": licenses.ORACLE_OP7,
    "op8_warc": warc.ORACLE_OP8,
    "op9_secrets": secrets.ORACLE_OP9,
    "op13_infill": infill.ORACLE_OP13,
}
