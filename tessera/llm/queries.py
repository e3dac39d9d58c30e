"""The queries of this folder and, where SQL can express them, their SQL."""

from tessera.llm import chat, codes, huffman, infilling, licences, nearest, packing, pieces, quality, sharding, simhash, substrings, suffixes

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_substrings": substrings.op2_substrings,
    "op3_sharding": sharding.op3_sharding,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_packing": packing.op5_packing,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_quality": quality.op7_quality,
    "op8_licences": licences.op8_licences,
    "op9_nearest": nearest.op9_nearest,
    "op10_simhash": simhash.op10_simhash,
    "op11_huffman": huffman.op11_huffman,
    "op12_infilling": infilling.op12_infilling,
    "op13_codes": codes.op13_codes,
}
ORACLES = {
    "op1_chat": chat.ORACLE_OP1,
    "op2_substrings": substrings.ORACLE_OP2,
    "op3_sharding": sharding.ORACLE_OP3,
    "op7_quality": quality.ORACLE_OP7,
    "op8_licences": licences.ORACLE_OP8,
    "op9_nearest": nearest.ORACLE_OP9,
    "op12_infilling": infilling.ORACLE_OP12,
    "op13_codes": codes.ORACLE_OP13,
}
