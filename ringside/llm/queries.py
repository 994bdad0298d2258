"""Queries of the numbered operators and their SQL twins, for the driver's entry file."""

from . import (
    alignment,
    debruijn,
    decontam,
    html_density,
    merkle,
    mixing,
    quality,
    secrets,
    sharding,
    subspace_join,
    suffix_sort,
    tokens,
    weighted_minhash,
)

QUERIES = {
    "op1_token_orc": tokens.query,
    "op2_decontaminate": decontam.query,
    "op3_suffix_cover": suffix_sort.query,
    "op4_subspace_join": subspace_join.query,
    "op5_secret_models": secrets.query,
    "op6_debruijn": debruijn.query,
    "op7_html_density": html_density.query,
    "op8_mix_sources": mixing.query,
    "op9_quality_discriminant": quality.query,
    "op10_weighted_minhash": weighted_minhash.query,
    "op11_merkle_witness": merkle.query,
    "op12_asof_alignment": alignment.query,
    "op13_rendezvous": sharding.query,
}

#: Encoding, walks, samples, suffix ranks and fitted scores have no SQL form; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op11_merkle_witness": merkle.ORACLE,
    "op13_rendezvous": sharding.ORACLE,
}
