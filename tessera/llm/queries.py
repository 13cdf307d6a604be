"""Queries of this subpackage, and SQL for those that SQL can express."""

from tessera.llm.bpe import op4_byte_bpe
from tessera.llm.langid import op9_langid
from tessera.llm.merkle import op1_merkle
from tessera.llm.mixing import op2_mixing
from tessera.llm.pii import op5_pii
from tessera.llm.rabitq import OP3_SQL, op3_rabitq
from tessera.llm.rans import op8_rans
from tessera.llm.simhash import op6_simhash
from tessera.llm.toxicity import op10_toxicity
from tessera.llm.warc import OP7_SQL, op7_warc


def queries():
    return {
        "op1_merkle": op1_merkle,
        "op2_mixing": op2_mixing,
        "op3_rabitq": op3_rabitq,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_pii": op5_pii,
        "op6_simhash": op6_simhash,
        "op7_warc": op7_warc,
        "op8_rans": op8_rans,
        "op9_langid": op9_langid,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql():
    return {"op3_rabitq": OP3_SQL, "op7_warc": OP7_SQL}
