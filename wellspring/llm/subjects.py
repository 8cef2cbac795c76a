"""Subject areas of documents.

Curated terms of each subject, in English, Spanish and Chinese, and terms learned from
the labelled sample go into one multi-pattern automaton. It runs over every running
sentence; a term counts by its weight times its rarity over all documents; a sentence
has the subject of the greatest score, and a document every subject whose share of its
running sentences reaches the subject's threshold. Shares normalise by length.

Weights and thresholds come from the labelled sample: a term weighs by how much more
often it stands in documents of its subject than in others, a learned term is a word,
pair of words or run of characters that tells a subject where no curated term does, and
a threshold is the share at which a subject is told best. Standing phrases, headers,
markup and tables are no running sentences.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.tables import cut

THRESHOLD = 0.25  # of a subject without labels
GRID = tuple(round(0.15 + 0.01 * i, 2) for i in range(16))  # thresholds compared, 0.15 to 0.30
SAMPLE = 2000  # labelled documents that terms are learned from, at most
LEAST_DOCUMENTS = 3  # of the sample that a learned or weighed term must stand in
LEAST_SHARE = 0.8  # of a learned term's occurrences, per document of each subject, in its own subject

# Curated terms, folded (see folded()); a trailing * lets a term end inside a word.
ENGLISH = {
    "geology": "outcrop*, sandstone*, shale, claystone*, limestone*, siltstone*, dolomite*, anhydrite, feldspar, quartz, mica, chert, glauconite, calcite, fossil*, lacustrine, marine, fluvial, deltaic, facies, sediment*, bioturbat*, lithology, coal seam*, anticline*, uplift*, folding, thin section*, source rock*, source bed*, stratigraph*, marker bed*, erosion*, cementation, grain*, bedding, pinch-out*, seal rock*, trap",
    "geophysics": "seismic*, seismogram*, wavelet*, deconvolution, velocity model*, interval velocit*, depth conversion, trace header*, crossline*, inline*, fold of, shot*, swath*, gravity, magnetic*, reflection*, reflector*, multiples, migration, milliseconds, checkshot*, amplitude*, horizon pick*, synthetic*, bin spacing, interpreter*, geophone*",
    "petrophysics": "net pay, cutoff*, shale volume, water saturation, porosity, permeability, neutron, density log*, resistivity, ohm metre*, gamma ray, caliper, rugose, invasion, baseline*, depth match*, washout*, cementation exponent, log curve*, sonic log*, laminated",
    "drilling": "drill*, drill bit, new bit, bit run*, mud weight, mud losses, lost circulation, casing, liner, inclination, azimuth, kick tolerance, hole section*, shale shaker*, stuck pipe, tripp*, ream*, motor, torque, drag, rig, cemented, wiper trip*, jar*",
    "production": "liquid rate*, oil rate*, gas lift, water cut, shut in, build-up test*, uptime, allocation, battery, oil a day, injection, reservoir pressure, tubing pressure, separator*, decline*, choke*, flowline*, acid*, scale, pump*, cumulative output",
    "law": "consent, ministry, statute*, licensee*, licence*, notice of default, surrender*, liability, misconduct, assignment, regulator*, landowner*, easement*, court*, appeal*, counsel, confidentiality, clause*, arbitration, dispute*, permit*, renewal*, parties, undertaking*",
    "finance": "tax*, break-even, joint account*, vendor*, rebate*, payment*, accrual*, capital account*, cost centre*, overhead*, depreciation, cash call*, invoice*, purchase order*, present value, discount*, audit*, voucher*, budget*, spending, rental*, booked, billed",
    "safety": "investigation*, fatigue, hot work, fire watch, spill*, absorbent*, booms, toolbox talk*, pinch point*, injur*, lost-time, eyewash, hard hat*, harness*, gas detector*, alarm*, evacuat*, muster*, guard rail*, walkway*, first-aid, near miss*, chemical store*",
    "software": "database*, index*, server*, memory, parsing, parser*, api, token expir*, library version*, upgrade*, build, button*, unit test*, exporter*, script*, duplicate key*, log file*, timeout*, backup*, node, import job*, decoding, cache*, bug*",
    "sport": "referee*, defender*, half time, volleyball, league*, runner*, marathon*, goalkeeper*, penalty, jersey*, cup final*, coach*, midfield*, derby, cycling, chess, table tennis, spectator*, swimmer*, medley, football, relay, training, match*, goal*",
}
SPANISH = {
    "geology": "testigo*, estratificacion, bioturbacion, afloramiento*, arenisca*, lutita*, arcilla*, fosil*, marino, lacustre, carbon, cuarzo, calcita, granos, trampa, sello, roca madre, facies, formacion, sedimento*",
    "geophysics": "sismic*, velocidades, sismograma*, sintetico*, interprete, horizonte*, traza*, reflexion*, milisegundos, multiples, amplitud*, gravimetr*, magnetic*, conversion a profundidad",
    "petrophysics": "porosidad, neutron, rayo gamma, saturacion de agua, resistividad, ohm metro*, espesor neto, valores de corte, calibre, permeabilidad, exponente, curva",
    "drilling": "perfor*, barrena, sarta, hoyo, revestidor, lodo, perdidas, inclinacion, azimut, motor, cemento, equipo de perforacion, repasar",
    "production": "produjo, produccion, metros cubicos, petroleo por dia, corte de agua, declinacion, estrangulador, presion de cabeza, bomba, caudal, inyeccion, restitucion, fluir",
    "law": "regulador, cesion, incumplimiento, confidencialidad, contratista*, clausula*, controversia*, arbitraje, tribunal, apelacion, permiso, renovacion, propietario*, servidumbre, partes",
    "finance": "provision, cuenta de capital, depreciacion, proveedor*, descuento, pago, precio de equilibrio, auditor*, comprobante*, factura*, presupuesto, alquiler*, impuesto*",
    "safety": "accidente*, eslinga, casco, arnes, brigada, simulacro, evacuacion, trabajo en caliente, vigia, barandas, pasarela, detector*, derrame, absorbente*, seguridad",
    "software": "base de datos, indice*, importacion, codificacion, version, cache, error*, servidor, memoria, archivo*, registro, tiempo de espera, claves duplicadas, pruebas unitarias, exportador, interfaz, copias de seguridad",
    "sport": "arbitro, defensa, descanso, portero, penal, ciclista, futbol, liga, voleibol, entrenamiento, carrera, relevos, nadador*, equipo gano, torneo",
}
CHINESE = {
    "geology": "岩心, 交错层理, 沉积, 露头, 砂岩, 泥岩, 砂泥, 圈闭, 断块, 盖层, 烃源岩, 抬升, 生物扰动, 煤线, 胶结物, 方解石, 分选",
    "geophysics": "地震, 偏移, 面元, 反射, 同相轴, 多次波, 速度模型, 时深, 检波点, 测线, 层位, 道头, 振幅, 合成记录",
    "petrophysics": "自然伽马, 基线, 密度和中子, 孔隙度, 有效厚度, 截止值, 侵入, 电阻率, 含水饱和度, 胶结指数, 测井, 扩径",
    "drilling": "钻进, 钻速, 泥浆, 漏失, 划眼, 卡钻, 震击, 起钻, 钻头, 马达, 造斜, 方位, 套管, 固井, 钻机",
    "production": "气举, 时率, 换泵, 产量, 注水, 地层压力, 油管压力, 分离器, 停喷, 关井, 压力恢复, 油嘴, 递减, 产油",
    "law": "违约, 作业者, 土地所有人, 地役权, 异议, 保密, 承包商, 争议, 仲裁, 监管, 转让, 许可证, 延期, 法院, 上诉",
    "finance": "税, 盈亏平衡, 供应商, 返利, 付款, 发票, 采购, 折旧, 审计, 凭证, 记账, 筹款, 预算, 租赁, 超支",
    "safety": "高处作业, 安全带, 安全帽, 泄漏, 围油栏, 动火, 作业票, 监护, 吊索, 未遂, 报警, 撤离, 疏散, 演练, 护栏, 走道, 整改",
    "software": "导入任务, 编码, 服务器, 解析, 内存, 日志, 超时, 脚本, 数据库, 索引, 版本, 缓存, 缺陷, 单元测试, 导出, 接口, 令牌",
    "sport": "排球, 联赛, 骑行, 俱乐部, 足球, 战胜, 接力, 训练, 守门员, 点球, 教练, 中场, 球员, 游泳, 裁判, 决赛",
}

# words of phrases that stand in documents of every subject
_STANDING = re.compile(
    r"^(please see the attached|regards\b|no further remarks|distribution: |this note replaces|recorded on|page \d|from: |ref: |see attached|ver hoja adjunta|solo para uso interno|sin mas comentarios|"
    r"esta nota reemplaza|saludos|pagina \d|registrado el|第\d+页|本说明替代|仅限内部|详见附件|无其他|~|vers\.|well\.|null\.)"
)
_TABLE = re.compile(r"^[\s\d.,;:|+\-/%()]*$|^[\w/]+\.[\w/]*\s+:|^[a-z]{3}-?\w+ \| \d{4}")
_HEADER = re.compile(r"^\s*~|^\s*[a-z]+\s*\.[\w/]*\s.*:", re.M)
_STAMP = re.compile(r"^\[[\d:. \-t]+\]\s*(info|warn|error|debug)?\s*")
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>")
_BREAK = re.compile(r"(?<=[.!?])[\s\"')\]]+|(?<=[。！？])|[\r\n]+")
_BULLET = re.compile(r"^[\s\-*•·>]+")


def _undamaged(m: re.Match) -> str:
    """UTF-8 that was read as a Western code page."""
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def folded(text: str) -> str:
    """NFKC, lower case, without accents; digits read as letters inside words."""
    if not text.isascii():
        text = re.sub(r"[\u00c2-\u00c5][\u0080-\u00ff\u0152-\u2122]", _undamaged, text)
        t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower())
        text = regex.sub(r"[\p{M}\p{Cf}]+", "", t).replace("ı", "i")
    t = text.lower()
    return re.sub(r"(?<=[a-z])[01](?=[a-z])|(?<=[a-z]{2})[01]\b|\b[01](?=[a-z]{2})", lambda m: "ol"[int(m[0])], t)


def sentences(text: str) -> list[str]:
    """Running sentences, folded: no markup, headers, tables or standing phrases."""
    t = folded(_MARKUP.sub(" ", html.unescape(text)))
    out = []
    running = "\n".join(line for line in t.splitlines() if not _HEADER.match(line))
    for s in _BREAK.split(running):
        s = _BULLET.sub("", _STAMP.sub("", _BULLET.sub("", s))).strip()
        letters = sum(c.isalpha() for c in s)
        if letters < 4 or _STANDING.match(s) or _TABLE.match(s) or letters * 2 < len(s.replace(" ", "")):
            continue
        out.append(s)
    return out


def curated() -> list[tuple[str, str]]:
    """(term, subject) of all languages."""
    return [(t, subject) for listed in (ENGLISH, SPANISH, CHINESE) for subject, line in listed.items() for t in line.split(", ")]


@dataclass
class Terms:
    """Terms (text, subject) compiled for matching."""

    listed: list[tuple[str, str]]
    automaton: ahocorasick.Automaton = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.automaton = a = ahocorasick.Automaton()
        for i, (term, _) in enumerate(self.listed):
            text = term.rstrip("*")
            a.add_word(text, (*a.get(text, ()), (i, len(text), text.isascii(), not term.endswith("*"))))
        a.make_automaton()

    def found(self, sentence: str) -> list[int]:
        """Term numbers in a sentence: longest mentions that do not overlap."""
        hits = []
        for last, owners in self.automaton.iter(sentence):
            for i, n, latin, whole in owners:
                start, end = last - n + 1, last + 1
                if latin and (start and sentence[start - 1].isalnum() or whole and end < len(sentence) and sentence[end].isalnum()):
                    continue
                hits.append((n, start, end, i))
        if len(hits) > 1:
            hits.sort(key=lambda h: -h[0])
            kept: list = []
            for h in hits:
                if all(h[2] <= k[1] or h[1] >= k[2] or h[1:3] == k[1:3] for k in kept):
                    kept.append(h)
            hits = kept
        return [h[3] for h in hits]

    def in_text(self, text: str | None) -> list[list[int]]:
        """Term numbers of each running sentence."""
        return [self.found(s) for s in sentences(text or "")]


_compiled: dict[tuple, Terms] = {}


def _terms(listed: list[tuple[str, str]]) -> Terms:
    """Terms compiled once per worker process."""
    key = tuple(listed)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Terms(listed)
    return _compiled[key]


def grams(sentence: str) -> set[str]:
    """Words of three letters at least, pairs of neighbouring words, and runs of two to
    four Chinese characters; nothing with a digit."""
    words = re.findall(r"[^\W\d_]+", re.sub(r"[\u3400-\u9fff]+", " ", sentence))
    out = {w for w in words if len(w) > 2} | {m[0] for m in re.finditer(r"(?<![^\W_])[^\W\d_]{2,} [^\W\d_]{2,}(?![^\W_])", sentence) if m[0].isascii()}
    out |= {m[1] for m in re.finditer(r"(?=(?<![^\W_])([a-z]{2,} [a-z]{2,})(?![^\W_]))", sentence)}
    for run in re.findall(r"[\u3400-\u9fff]+", sentence):
        out |= {run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)}
    return out


def _log_odds(own: int, others: int, n_own: int, n_others: int) -> float:
    """How much likelier a term is in a document of its subject than in another."""
    return math.log(((own + 0.5) / (n_own + 1)) / ((others + 0.5) / (n_others + 1)))


def learned_terms(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str, float]]:
    """(term, subject, weight) from labelled documents of one subject, at most `sample`
    of them, chosen by the hash of their id: curated terms weighed by their log odds (1
    where the sample does not show them, none where it speaks against them), and grams
    of sentences without a curated term that tell a subject in all sentences. Counts are
    aggregated before they reach the driver; their number is bounded by the sample."""
    one = labels.where("doc_id is not null and subject_code is not null").groupBy("doc_id").agg(F.collect_set("subject_code").alias("s")).where("size(s) = 1").select("doc_id", F.col("s")[0].alias("subject"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    listed = curated()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _terms(listed)
        for b in batches:
            rows = []
            for text, subject in zip(b["text"], b["subject"]):
                said: set = set()
                for s in sentences(text or ""):
                    hits = known.found(s)
                    parts = grams(s)
                    said |= {("t", str(i)) for i in hits} | {("g", g) for g in parts} | (set() if hits else {("u", g) for g in parts})
                rows += [(subject, kind, term) for kind, term in said] + [(subject, "d", "")]
            yield pd.DataFrame(rows, columns=["subject", "kind", "term"])

    # the sample is bounded; its documents are found by a scan, not a shuffle
    said = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "subject").mapInPandas(find, "subject string, kind string, term string")
    counts = cut(said.groupBy("kind", "term", "subject").agg(F.count("*").alias("n")).groupBy("kind", "term").agg(F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("by"), F.sum("n").alias("n")))
    new = counts.where((F.col("kind") == "u") & (F.col("n") >= LEAST_DOCUMENTS)).select(F.lit("g").alias("kind"), "term")
    got = counts.where(F.col("kind").isin("t", "d")).unionByName(counts.join(new, ["kind", "term"], "left_semi")).collect()
    size = next((dict(r["by"]) for r in got if r["kind"] == "d"), {})
    total = sum(size.values())
    odds = lambda by, s: _log_odds(by.get(s, 0), sum(by.values()) - by.get(s, 0), size.get(s, 0), total - size.get(s, 0))
    shown = {int(r["term"]): dict(r["by"]) for r in got if r["kind"] == "t" and r["n"] >= LEAST_DOCUMENTS}
    out = [(t, s, odds(shown[i], s) if i in shown else 1.0) for i, (t, s) in enumerate(listed)]
    for r in sorted((r for r in got if r["kind"] == "g"), key=lambda r: r["term"]):
        rate = {s: n / size[s] for s, n in dict(r["by"]).items()}
        best = min(rate, key=lambda s: (-rate[s], s))
        if rate[best] >= LEAST_SHARE * sum(rate.values()) and r["by"][best] >= LEAST_DOCUMENTS:
            out.append((r["term"], best, odds(dict(r["by"]), best)))
    return [(t, s, round(w, 6)) for t, s, w in out if w > 0]


def shares_of(found: list[list[int]], listed: list[tuple[str, str, float]], rarity: dict[int, float]) -> dict[str, float]:
    """Share of each subject in a document's running sentences. A sentence of no term at
    all speaks for no subject but counts as one."""
    count: Counter = Counter()
    for ids in found:
        score: Counter = Counter()
        for i in set(ids):
            score[listed[i][1]] += listed[i][2] * rarity.get(i, 1.0)
        if score:
            best = max(score.values())
            count[min(k for k, v in score.items() if v == best)] += 1
    return {k: n / len(found) for k, n in count.items()}


def document_shares(documents: DataFrame, listed: list[tuple[str, str, float]]) -> DataFrame:
    """(doc_id, subject_code, share) of documents (doc_id, text). The terms of each
    document are found once, kept, and counted over all documents for their rarity: as
    many counts as terms reach the driver."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _terms([(t, s) for t, s, _ in listed])
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "found": [known.in_text(t) for t in b["text"]]})

    found = cut(documents.select("doc_id", "text").mapInPandas(find, "doc_id long, found array<array<int>>"))
    per_doc = found.select(F.explode(F.array_distinct(F.flatten("found"))).alias("term"))
    n = found.count()
    rarity = {r["term"]: math.log(1 + n / r["count"]) for r in per_doc.groupBy("term").count().collect()}

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, x) for d, f in zip(b["doc_id"], b["found"]) for s, x in shares_of([list(i) for i in f], listed, rarity).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "subject_code", "share"])

    return found.mapInPandas(share, "doc_id long, subject_code string, share double")


def calibration(shares: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject_code, threshold, hits, false_positives, misses) of every threshold of the
    grid, on all labelled documents. One aggregation by subject and step of the grid."""
    truth = labels.where("doc_id is not null and subject_code is not null").select("doc_id", "subject_code").distinct()
    labelled = truth.select("doc_id").distinct()
    got = shares.join(labelled, "doc_id", "left_semi").groupBy("doc_id", "subject_code").agg(F.max("share").alias("share"))
    both = got.join(truth.withColumn("true", F.lit(True)), ["doc_id", "subject_code"], "full").select("subject_code", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("true", F.lit(False)).alias("true"))
    at = both.select("subject_code", "true", "share", F.explode(F.array(*[F.lit(x) for x in GRID])).alias("threshold"))
    over = F.col("share") >= F.col("threshold") - 1e-9
    return at.groupBy("subject_code", "threshold").agg(F.count_if(over & F.col("true")).alias("hits"), F.count_if(over & ~F.col("true")).alias("false_positives"), F.count_if(~over & F.col("true")).alias("misses"))


def best_thresholds(calibrated: DataFrame) -> dict[str, float]:
    """Threshold of each subject with the greatest F1, of equals the one nearest to a
    quarter. As many rows as subjects times thresholds reach the driver."""
    best: dict[str, tuple] = {}
    for r in calibrated.collect():
        f1 = 2 * r["hits"] / max(1, 2 * r["hits"] + r["false_positives"] + r["misses"])
        best[r["subject_code"]] = max(best.get(r["subject_code"], (-1.0,)), (f1, -abs(r["threshold"] - THRESHOLD), r["threshold"]))
    return {s: b[-1] for s, b in best.items()}


def document_subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject_code) of documents (doc_id, text), by terms and thresholds of the
    labels (doc_id, subject_code); rows only for documents with a subject. Null, empty
    and blank texts have none; repeated rows repeat their subjects; an empty table gives
    no rows. Without labels curated terms weigh alike and the threshold is a quarter."""
    shares = cut(document_shares(documents, learned_terms(documents, labels)))
    limits = best_thresholds(calibration(shares, labels))
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("subject_code")], F.lit(THRESHOLD)) if limits else F.lit(THRESHOLD)
    return shares.where(F.col("share") >= least - 1e-9).select("doc_id", "subject_code")


def unlabelled_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """p10_found: subjects of the subject list, for documents without labels. Rarity is
    counted over all documents, labelled ones too."""
    listed = F.broadcast(areas.select("subject_code").distinct())  # a fixed list
    found = document_subjects(documents, labels).join(listed, "subject_code", "left_semi").select("doc_id", "subject_code").distinct()
    return found.join(labels.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti")


def calibrated_subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Agreement with the labels at every threshold of the grid."""
    return calibration(document_shares(documents, learned_terms(documents, labels)), labels)
