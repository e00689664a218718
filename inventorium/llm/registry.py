"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import alignment, chat_format, decontaminate, langid, near_duplicates, packing, personal_data, quality, resampling, secret_scan, sharding, token_counts, topk_search


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_sharding": sharding.op2_sharding,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_personal_data": personal_data.op4_personal_data,
        "op5_topk": topk_search.op5_topk,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_language": langid.op7_language,
        "op8_near_duplicates": near_duplicates.op8_near_duplicates,
        "op9_quality": quality.op9_quality,
        "op10_packing": packing.op10_packing,
        "op11_chat": chat_format.op11_chat,
        "op12_alignment": alignment.op12_alignment,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.OP1_SQL,
        "op5_topk": topk_search.OP5_SQL,
        "op6_secrets": secret_scan.OP6_SQL,
        "op11_chat": chat_format.OP11_SQL,
        "op13_resampling": resampling.OP13_SQL,
    }
