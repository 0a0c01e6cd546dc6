"""Dimension data: names of drugs, methods and their weights, messages. All values here are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Standard name: its aliases, in the order in which ties are decided.
ALIASES = {
    "amisulpride": ("ami", "amisulpride", "amisulprid", "solian", "솔리안", "아미설프리드"),
    "aripiprazole": ("ari", "apz", "aripiprazole", "aripiprazol", "abilify", "아빌리파이", "아리피프라졸"),
    "asenapine": ("asen", "asenapine", "asenapin", "saphris", "사프리스", "아세나핀"),
    "brexpiprazole": ("bre", "brexpiprazole", "brexpiprazol", "rexulti", "렉설티", "브렉스피프라졸"),
    "chlorpromazine": ("cpz", "chlorpromazine", "chlorpromazin", "largactil", "라가틸", "클로르프로마진"),
    "clozapine": ("clz", "clozapine", "clozapin", "clozaril", "클로자릴", "클로자핀"),
    "fluphenazine": ("fluph", "fluphenazine", "fluphenazin", "prolixin", "플루페나진"),
    "haloperidol": ("hal", "haldol", "haloperidol", "haloperidolum", "할돌", "할로페리돌"),
    "iloperidone": ("ilo", "iloperidone", "iloperidon", "fanapt", "일로페리돈"),
    "lurasidone": ("lur", "lurasidone", "lurasidon", "latuda", "라투다", "루라시돈"),
    "olanzapine": ("ola", "olz", "olanzapine", "olanzapin", "zyprexa", "자이프렉사", "올란자핀"),
    "paliperidone": ("pal", "paliperidone", "paliperidon", "invega", "인베가", "팔리페리돈"),
    "perphenazine": ("per", "perphenazine", "perphenazin", "트릴라폰", "perphenan", "퍼페나진"),
    "quetiapine": ("qtp", "quetiapine", "quetiapin", "seroquel", "seroqel", "세로켈", "쿠에티아핀", "퀘티아핀", "케티아핀", "코티아핀"),
    "risperidone": ("ris", "rsp", "risperidone", "risperidon", "risperidonne", "risperdal", "리스페달", "리스페리돈"),
    "sertindole": ("sert", "sertindole", "sertindol", "serdolect", "세르틴돌"),
    "thioridazine": ("thio", "thioridazine", "thioridazin", "mellaril", "멜라릴", "티오리다진"),
    "thiothixene": ("thiothix", "thiothixene", "thiothixen", "navane", "티오틱센"),
    "trifluoperazine": ("tri", "trifluoperazine", "trifluoperazin", "stelazine", "스텔라진", "트리플루오페라진"),
    "ziprasidone": ("zip", "ziprasidone", "ziprasidon", "geodon", "지오돈", "지프라시돈"),
    "zotepine": ("zot", "zotepine", "zotepin", "lodopin", "로도핀", "조테핀"),
}

#: Method: (anchor, default target, amounts of each drug worth one unit of the anchor).
WEIGHTS = {
    "CMD": ("olanzapine", "chlorpromazine", (("amisulpride", 38.3), ("aripiprazole", 1.4), ("asenapine", 0.9), ("chlorpromazine", 38.9), ("clozapine", 30.6), ("haloperidol", 0.7), ("olanzapine", 1.0), ("quetiapine", 32.3), ("risperidone", 0.4), ("sertindole", 1.1), ("ziprasidone", 7.9), ("zotepine", 13.2))),
    "CPZ_FGA": ("chlorpromazine", "chlorpromazine", (("chlorpromazine", 1.0), ("fluphenazine", 0.012), ("haloperidol", 0.016), ("perphenazine", 0.089), ("thioridazine", 0.953), ("thiothixene", 0.052), ("trifluoperazine", 0.028))),
    "DDD": ("olanzapine", "chlorpromazine", (("amisulpride", 40), ("aripiprazole", 1.5), ("asenapine", 2), ("chlorpromazine", 30), ("clozapine", 30), ("haloperidol", 0.8), ("lurasidone", 8), ("olanzapine", 1), ("paliperidone", 0.6), ("quetiapine", 40), ("risperidone", 0.5), ("ziprasidone", 12), ("zotepine", 20))),
    "ED95": ("risperidone", "olanzapine", (("amisulpride", 85.238), ("aripiprazole", 1.825), ("asenapine", 2.381), ("brexpiprazole", 0.533), ("haloperidol", 1.0), ("iloperidone", 3.195), ("lurasidone", 23.333), ("olanzapine", 2.413), ("paliperidone", 2.127), ("quetiapine", 76.508), ("risperidone", 1.0), ("sertindole", 3.571), ("ziprasidone", 29.524))),
    "MED": ("olanzapine", "olanzapine", (("aripiprazole", 1.333), ("asenapine", 1.333), ("clozapine", 40), ("haloperidol", 0.533), ("iloperidone", 1.067), ("lurasidone", 5.333), ("olanzapine", 1), ("paliperidone", 0.4), ("quetiapine", 20), ("risperidone", 0.267), ("sertindole", 1.6), ("ziprasidone", 5.333))),
}

METHOD_WARNINGS = {
    "CMD": "급성 조현병 경구약 임상시험의 평균용량 기반이며 개인별 처방 권고가 아닙니다.",
    "CPZ_FGA": "1세대 항정신병약물의 역사적 CPZ 비교값입니다.",
    "DDD": "WHO DDD는 약물사용 연구용 기술 단위이며 권장용량 또는 처방용량이 아닙니다.",
    "ED95": "만성 조현병 급성 악화 집단의 평균 효과 기반이며 개인별 권장용량이 아닙니다.",
    "MED": "초발성 또는 치료저항성 환자에게 일반화할 수 없는 연구용 환산값입니다.",
}
ED95_HALOPERIDOL = " Haloperidol ED95 값은 단일 연구 기반의 제한적 추정치입니다."

#: method, basis, reference, limitation; in the order of the information sheet.
METHOD_INFO = (
    ("CMD", "Classical mean dose method", "Leucht et al. 2015; PMID 25841041", "급성 조현병 경구약 임상시험 평균용량 기반이며 개인별 처방 권고가 아님"),
    ("MED", "Minimum effective dose method", "Leucht et al. 2014; PMID 24493852", "초발성·치료저항성 환자에 일반화할 수 없음"),
    ("ED95", "95% effective dose method", "Leucht et al. 2020; PMID 31838873", "만성 조현병 급성 악화 집단의 평균 효과 기반; haloperidol 값은 단일 연구 기반 제한적 추정치"),
    ("DDD", "WHO Defined Daily Dose", "WHO ATC/DDD methodology", "약물사용 연구용 기술 단위이며 권장·처방 용량이 아님"),
    ("CPZ_FGA", "Historical chlorpromazine equivalents", "Davis 1974; PMID 4156792", "1세대 항정신병약물의 역사적 비교값"),
)

ASSUMED_WARNING = "복용 빈도 없음: 1일 1회로 계산"

#: Error code: message.
MESSAGES = {
    "EMPTY": "약물 값이 비어 있습니다.",
    "UNKNOWN_DRUG": "약물명을 확인할 수 없습니다.",
    "NO_DOSE": "mg, mcg 또는 g 단위의 용량이 없습니다.",
    "MULTI_DOSE": "한 항목에 용량이 여러 개 있어 일일 용량을 확정할 수 없습니다. 약물별·복용시간별로 행을 분리해 주세요.",
    "BAD_QUANTITY": "정제/캡슐 수량은 0보다 커야 합니다.",
    "BAD_DOSE": "용량은 0보다 커야 합니다.",
    "PRN": "PRN(필요시) 처방은 일일 용량을 확정할 수 없어 자동 환산하지 않습니다.",
    "LAI_OR_WEEKLY": "장기지속형 주사제/주 단위 처방은 경구 일일 용량으로 자동 환산하지 않습니다.",
    "BAD_INTERVAL": "시간 단위 복용 간격을 정확한 일일 횟수로 환산할 수 없습니다.",
    "BAD_TIMES": "일일 복용 횟수는 1~24회 범위여야 합니다.",
    "BAD_REGIMEN": "복용 일정의 총 투여량은 0보다 커야 합니다.",
    "FREQ_CONFLICT": "서로 다른 복용 빈도가 함께 있어 일일 용량을 확정할 수 없습니다.",
    "NO_CONVERSION": "{drug}에 사용할 수 있는 환산값이 없습니다.",
    "MULTI_DRUG_SPLIT_DOSE": "여러 약물이 한 셀에 있고 용량이 별도 열에 있어 자동 결합할 수 없습니다.",
    "NO_MED_COLUMN": "약물 열을 찾지 못했습니다.",
}

#: The message for a request without a text.
NO_TEXT = "약물과 용량을 입력해 주세요."

METHODS = tuple(sorted(WEIGHTS))


def alias_rows() -> list[tuple[int, str, str]]:
    """(place, alias, standard name)."""
    pairs = [(a, name) for name, aliases in ALIASES.items() for a in aliases]
    return [(k, a, name) for k, (a, name) in enumerate(pairs)]


def weight_rows() -> list[tuple[str, str, float]]:
    """(method, drug, weight)."""
    return [(m, drug, float(weight)) for m, (_, _, weights) in WEIGHTS.items() for drug, weight in weights]


def factor_rows() -> list[tuple[str, str, str, float]]:
    """(method, source drug, target drug, factor) for every pair of a method's drugs."""
    by: dict[str, list[tuple[str, float]]] = {}
    for m, d, w in weight_rows():
        by.setdefault(m, []).append((d, w))
    return [(m, s, t, wt / ws) for m, drugs in by.items() for s, ws in drugs for t, wt in drugs]


def dim_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "ord int, alias string, standard_name string")


def dim_weight(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(weight_rows(), "method_id string, drug string, weight double")


def dim_factor(spark: SparkSession) -> DataFrame:
    """Factors of all pairs within a method: a self join on the method."""
    w = dim_weight(spark)
    source = w.select("method_id", F.col("drug").alias("source_drug"), F.col("weight").alias("ws"))
    target = w.select("method_id", F.col("drug").alias("target_drug"), F.col("weight").alias("wt"))
    return source.join(target, "method_id").select("method_id", "source_drug", "target_drug", (F.col("wt") / F.col("ws")).alias("factor"))


def dim_method(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, WEIGHTS[m][0], WEIGHTS[m][1], METHOD_WARNINGS[m]) for m in METHODS], "method string, anchor string, target_drug string, warning string")


def method_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METHOD_INFO), "method string, basis string, reference string, limitation string")


def dim_message(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MESSAGES.items()), "code string, message string")
