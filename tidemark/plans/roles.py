"""Clinical-shaped tables derived from the star-schema and event tables.

The operators expect stays, lab events, chart events and so on.  Here each of those tables is
one SELECT over the given tables, in SQL that Spark and DuckDB both read, so that the queries and
their check statements start from the same rows.  `SECS(x)` stands for whole epoch seconds.

Timestamp clock, label study: stay = user, from the first to the last event.
Timestamp clock, cohort study: stay = order, patient = customer.
Offset clock: stay = order, site = nation, events = line items.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import cut_lineage, size_shuffles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ROLES: dict[str, str] = {
    # --- label study on the event stream ------------------------------------------
    "ev": """
        SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
        FROM events""",
    "icustays": """
        SELECT user_id AS subject_id, user_id AS hadm_id, user_id AS stay_id, min(ts) AS intime, max(ts) AS outtime,
               (SECS(max(ts)) - SECS(min(ts))) / 86400e0 AS los
        FROM events GROUP BY user_id""",
    "patients": """
        SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CAST(15 + c_custkey % 75 AS INTEGER) AS anchor_age, CAST(2024 - c_custkey % 3 AS INTEGER) AS anchor_year,
               c_mktsegment AS anchor_year_group
        FROM customer""",
    "admissions": """
        SELECT i.hadm_id, i.intime AS admittime, i.outtime AS dischtime,
               CASE c.c_nationkey % 4 WHEN 0 THEN 'EMERGENCY' WHEN 1 THEN 'ELECTIVE' WHEN 2 THEN 'URGENT' END AS admission_type,
               CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS hospital_expire_flag
        FROM icustays i JOIN customer c ON c.c_custkey = i.subject_id""",
    "labevents": """
        SELECT user_id AS hadm_id, ts AS charttime,
               CASE event_type
                 WHEN 'view' THEN CASE WHEN k < 34 THEN 50912 WHEN k < 67 THEN 51265 ELSE 50885 END
                 WHEN 'click' THEN CASE WHEN k < 50 THEN 50821 WHEN k < 75 THEN 50813 ELSE 50931 END
                 ELSE CASE k % 3 WHEN 0 THEN 51301 WHEN 1 THEN 50983 ELSE 51006 END END AS itemid,
               CASE event_type
                 WHEN 'view' THEN CASE WHEN k < 34 THEN value / 25e0 WHEN k < 67 THEN value * 4e0 ELSE value / 20e0 END
                 WHEN 'click' THEN CASE WHEN k < 50 THEN value * 4e0 WHEN k < 75 THEN value / 10e0 ELSE value * 5e0 END
                 ELSE CASE k % 3 WHEN 0 THEN value / 4e0 WHEN 1 THEN 100e0 + value / 2e0 ELSE value END END AS valuenum
        FROM ev WHERE event_type IN ('view', 'click', 'signup')""",
    "chartevents": """
        SELECT e.user_id AS stay_id, e.ts AS charttime,
               CASE m.item WHEN 'map' THEN 220052 WHEN 'fio2' THEN 223835 WHEN 'eye' THEN 220739 WHEN 'verbal' THEN CASE WHEN e.k % 7 = 0 THEN 1 ELSE 223900 END WHEN 'motor' THEN 223901
                    WHEN 'vent' THEN CASE WHEN e.k < 20 THEN 220339 WHEN e.k < 40 THEN 223849 ELSE 1 END
                    WHEN 'weight' THEN CASE WHEN e.k < 30 THEN 226512 WHEN e.k < 60 THEN 226531 ELSE 1 END
                    WHEN 'pulse' THEN 220045 ELSE CASE WHEN e.k % 2 = 0 THEN 223761 ELSE 223762 END END AS itemid,
               CASE WHEN m.item = 'vent' AND e.k >= 20 THEN 'SIMV' END AS value,
               CASE m.item WHEN 'map' THEN 50e0 + e.value WHEN 'fio2' THEN CASE WHEN e.k % 4 = 0 THEN e.k / 100e0 ELSE 15e0 + e.k END
                    WHEN 'eye' THEN 1e0 + e.k % 4 WHEN 'verbal' THEN 1e0 + e.k % 5 WHEN 'motor' THEN 1e0 + e.k % 6
                    WHEN 'vent' THEN CASE WHEN e.k < 20 THEN e.value END
                    WHEN 'weight' THEN CASE WHEN e.k < 30 THEN 15e0 + e.value ELSE 90e0 + e.value END
                    WHEN 'pulse' THEN 50e0 + e.value ELSE CASE WHEN e.k % 2 = 0 THEN 90e0 + e.k / 5e0 ELSE 30e0 + e.k / 6e0 END END AS valuenum
        FROM ev e JOIN (VALUES ('view', 'map'), ('purchase', 'map'), ('click', 'fio2'), ('signup', 'eye'), ('signup', 'verbal'), ('signup', 'motor'),
                               ('error', 'vent'), ('purchase', 'weight'), ('error', 'pulse'), ('signup', 'pulse'), ('view', 'temperature')) AS m(kind, item)
             ON m.kind = e.event_type""",
    "outputevents": """
        SELECT user_id AS stay_id, ts AS charttime, CASE WHEN k % 10 = 0 THEN 227488 ELSE 226559 END AS itemid,
               CAST(floor(value * 6e0) AS DOUBLE) AS value
        FROM ev WHERE event_type IN ('purchase', 'error')""",
    "inputevents": """
        SELECT user_id AS stay_id, ts AS starttime, ts + INTERVAL '1' MINUTE * (k * 10) AS endtime,
               CASE k % 5 WHEN 0 THEN 221906 WHEN 1 THEN 221289 WHEN 2 THEN 221662 WHEN 3 THEN 221653 ELSE 222315 END AS itemid,
               value / 100e0 AS rate,
               CASE k % 7 WHEN 0 THEN 'mcg/kg/min' WHEN 1 THEN 'mg/kg/min' WHEN 2 THEN 'mcg/min' WHEN 3 THEN 'mg/min'
                          WHEN 4 THEN 'mcg/kg/hr' WHEN 5 THEN 'mg/kg/hr' ELSE 'units/hour' END AS rateuom
        FROM ev WHERE event_type = 'purchase'""",
    "procedureevents": """
        SELECT user_id AS stay_id, ts AS starttime,
               CASE k % 4 WHEN 0 THEN 225792 WHEN 1 THEN 225794 WHEN 2 THEN 227194 ELSE 1 END AS itemid
        FROM ev WHERE event_type = 'click'""",
    "prescriptions": """
        SELECT user_id AS hadm_id, ts AS starttime,
               CASE k % 8 WHEN 0 THEN 'Vancomycin HCl' WHEN 1 THEN 'CefePIME 2g' WHEN 2 THEN 'Aspirin' WHEN 3 THEN 'Heparin'
                          WHEN 4 THEN 'Meropenem' WHEN 5 THEN 'ciprofloxacin IV' WHEN 6 THEN 'SMZ-TMP' ELSE 'PC Pen VK' END AS drug,
               CASE k % 7 WHEN 0 THEN 'IV' WHEN 1 THEN 'PO' WHEN 2 THEN 'OU' WHEN 3 THEN NULL WHEN 4 THEN 'IV DRIP'
                          WHEN 5 THEN 'Left Eye' ELSE 'IM' END AS route
        FROM ev WHERE event_type = 'purchase'""",
    "microbiologyevents": """
        SELECT user_id AS hadm_id, CASE WHEN k % 5 = 0 THEN NULL ELSE ts END AS charttime, CAST(ts AS DATE) AS chartdate,
               CASE k % 7 WHEN 0 THEN 'BLOOD CULTURE' WHEN 1 THEN 'Urine' WHEN 2 THEN 'MRSA SCREEN' WHEN 3 THEN 'Tissue'
                          WHEN 4 THEN NULL WHEN 5 THEN 'Staph aureus swab' ELSE 'SPUTUM' END AS spec_type_desc
        FROM ev WHERE event_type = 'error'""",
    "poe": """
        SELECT user_id AS hadm_id,
               CASE k % 4 WHEN 0 THEN 'Lab' WHEN 1 THEN 'Microbiology' WHEN 2 THEN 'Radiology' ELSE 'Labs and tests' END AS order_type,
               CASE k % 5 WHEN 0 THEN 'Blood Cx' WHEN 1 THEN 'Wound Culture' WHEN 2 THEN 'Chemistry' WHEN 3 THEN NULL ELSE 'Micro' END AS order_subtype,
               CASE WHEN k % 9 = 0 THEN 'not timed' ELSE CAST(ts AS VARCHAR(30)) END AS ordertime
        FROM ev WHERE event_type IN ('signup', 'click')""",
    "diagnoses_icd": """
        SELECT user_id AS hadm_id, CASE WHEN k >= 30 THEN 'R69' ELSE CASE k % 6 WHEN 0 THEN 'U07.1' WHEN 1 THEN 'u071' WHEN 2 THEN 'J18.9' ELSE 'A41.9' END END AS icd_code,
               CASE WHEN k % 12 < 6 THEN 10 ELSE 9 END AS icd_version
        FROM ev WHERE event_type = 'signup'""",
    # --- cohort study on orders -----------------------------------------------------
    "order_stays": """
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey AS stay_id, o_orderdate AS intime,
               o_orderdate + INTERVAL '1' DAY AS outtime, o_totalprice / 100000e0 AS los, o_orderpriority AS first_careunit
        FROM orders""",
    "order_admissions": """
        SELECT o_orderkey AS hadm_id, o_orderdate AS admittime, o_orderdate AS dischtime, o_orderpriority AS admission_type,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hospital_expire_flag
        FROM orders""",
    "order_patients": """
        SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CAST(12 + c_custkey % 75 AS INTEGER) AS anchor_age, CAST(1995 + c_custkey % 5 AS INTEGER) AS anchor_year,
               c_mktsegment AS anchor_year_group
        FROM customer""",
    "order_events": """
        SELECT l_orderkey AS hadm_id, l_linenumber AS itemid, l_shipdate AS charttime,
               CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS valuenum
        FROM lineitem""",
    # --- offset clock -----------------------------------------------------------------
    "o_patient": """
        SELECT o.o_orderkey AS patientunitstayid, o.o_custkey AS uniquepid, c.c_nationkey AS hospitalid,
               CAST(floor(o.o_totalprice / 80e0) AS INTEGER) AS unitdischargeoffset,
               CASE o.o_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS gender,
               CASE WHEN o.o_custkey % 17 = 0 THEN '> 89' WHEN o.o_custkey % 19 = 0 THEN ''
                    ELSE CAST(12 + o.o_custkey % 75 AS VARCHAR(5)) END AS age,
               CASE WHEN o.o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(15 + o.o_orderkey % 130 AS VARCHAR(5)) END AS admissionweight,
               CAST(year(o.o_orderdate) AS INTEGER) AS hospitaldischargeyear, o.o_orderkey % 1000 AS patienthealthsystemstayid,
               o.o_orderkey % 3 + 1 AS unitvisitnumber, o.o_orderpriority AS unitadmitsource
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "o_hospital": """
        SELECT n.n_nationkey AS hospitalid, r.r_name AS region,
               CASE n.n_nationkey % 3 WHEN 0 THEN '<100' WHEN 1 THEN '100 - 249' ELSE '>= 500' END AS numbedscategory,
               CASE WHEN n.n_nationkey % 2 = 0 THEN 't' ELSE 'f' END AS teachingstatus
        FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "o_line": """
        SELECT l.l_orderkey AS patientunitstayid, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_returnflag, l.l_linestatus,
               CAST(floor((SECS(l.l_shipdate) - SECS(o.o_orderdate)) / 21600e0) AS INTEGER) AS off
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "o_lab": """
        SELECT patientunitstayid, off AS labresultoffset,
               CASE l_partkey % 8 WHEN 0 THEN 'creatinine' WHEN 1 THEN 'Creatinine, serum' WHEN 2 THEN 'platelets x 1000' WHEN 3 THEN 'total bilirubin'
                    WHEN 4 THEN 'paO2' WHEN 5 THEN 'HCO3' WHEN 6 THEN 'glucose' ELSE 'WBC x 1000' END AS labname,
               CASE l_partkey % 8 WHEN 0 THEN l_quantity / 10e0 WHEN 1 THEN l_quantity / 10e0 WHEN 2 THEN l_quantity * 8e0 WHEN 3 THEN l_quantity / 4e0
                    WHEN 4 THEN l_quantity * 10e0 WHEN 5 THEN l_quantity WHEN 6 THEN l_quantity * 6e0 ELSE NULL END AS labresult
        FROM o_line""",
    "o_periodic": """
        SELECT patientunitstayid, off AS observationoffset, 40e0 + l_quantity AS heartrate, 60e0 + l_quantity * 2e0 AS systemicsystolic,
               CAST(NULL AS DOUBLE) AS systemicdiastolic, 35e0 + l_quantity * 1.5e0 AS systemicmean, l_quantity AS respiration,
               70e0 + l_quantity AS sao2, 20e0 + l_quantity / 2e0 AS temperature
        FROM o_line WHERE l_returnflag = 'A'""",
    "o_aperiodic": """
        SELECT patientunitstayid, off AS observationoffset, 70e0 + l_quantity * 3e0 AS noninvasivesystolic, l_quantity + 20e0 AS noninvasivediastolic,
               30e0 + l_quantity * 2e0 AS noninvasivemean
        FROM o_line WHERE l_returnflag = 'R'""",
    "o_nurse": " UNION ALL ".join(f"""
        SELECT patientunitstayid, off AS nursingchartoffset, CASE WHEN {charted} THEN '{name}' ELSE 'Pain Level' END AS nursingchartcelltypevalname,
               {value} AS nursingchartvalue FROM o_line""" for name, charted, value in [
        ("GCS Total", "l_returnflag = 'N' AND l_partkey % 2 = 0",
         "CASE WHEN l_partkey % 6 = 0 THEN 'unable' ELSE CAST(CAST(floor(1 + l_quantity / 3e0) AS INTEGER) AS VARCHAR(5)) END"),
        ("Eyes", "l_linestatus = 'O'", "CAST(1 + l_partkey % 4 AS VARCHAR(5))"),
        ("Verbal", "l_linestatus = 'O' AND l_partkey % 7 <> 0", "CAST(1 + l_partkey % 5 AS VARCHAR(5))"),
        ("Motor", "l_linestatus = 'O'", "CAST(1 + l_partkey % 6 AS VARCHAR(5))"),
    ]),
    "o_intake": """
        SELECT patientunitstayid, off AS intakeoutputoffset, l_quantity * 10e0 AS cellvaluenumeric,
               CASE l_partkey % 6 WHEN 0 THEN 'Urine' WHEN 1 THEN 'Foley cath' WHEN 2 THEN 'Oral' WHEN 3 THEN 'Urine irrigant' WHEN 4 THEN 'VOID' ELSE NULL END AS celllabel
        FROM o_line""",
    "o_respiratory": """
        SELECT patientunitstayid, CASE WHEN l_partkey % 10 = 0 OR l_suppkey % 4 <> 0 THEN 'later' ELSE CAST(off AS VARCHAR(10)) END AS respchartoffset
        FROM o_line""",
    "o_infusion": """
        SELECT patientunitstayid, CASE WHEN l_partkey % 10 = 0 THEN '' ELSE CAST(off AS VARCHAR(10)) END AS infusionoffset,
               CASE WHEN l_linenumber > 3 THEN 'Propofol' ELSE
                    CASE l_suppkey % 6 WHEN 0 THEN 'Norepinephrine (mcg/min)' WHEN 1 THEN 'Levophed' WHEN 2 THEN 'EPINEPHrine (ml/hr)'
                    WHEN 3 THEN 'Dopamine' WHEN 4 THEN 'Propofol' ELSE 'DOBUTamine' END END AS drugname
        FROM o_line""",
    "o_treatment": """
        SELECT patientunitstayid, off AS treatmentoffset,
               CASE WHEN l_linenumber < 3 THEN 'nutrition' ELSE
                    CASE l_suppkey % 5 WHEN 0 THEN 'infectious diseases|Cultures|blood' WHEN 1 THEN 'medications|Antibacterials' WHEN 2 THEN 'antibiotic therapy'
                    WHEN 3 THEN 'nutrition' ELSE NULL END END AS treatmentstring
        FROM o_line""",
    # Cultures of the last line belong to a stay; all others name none, as records of other units do.
    "o_micro": """
        SELECT CASE WHEN l_linenumber = 7 THEN patientunitstayid END AS patientunitstayid, off AS culturetakenoffset,
               CASE l_suppkey % 9 WHEN 0 THEN 'No growth' WHEN 1 THEN 'Staphylococcus aureus' WHEN 2 THEN 'Escherichia coli' WHEN 3 THEN NULL
                    WHEN 4 THEN 'NEGATIVE' ELSE 'mixed flora' END AS organism,
               CASE WHEN l_partkey % 2 = 0 THEN 'Blood' ELSE 'Urine' END AS culturesite
        FROM o_line""",
    # --- scored units: two labels, two models, two seeds --------------------------------
    "scored": """
        SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic, d.n_chars,
               length(d.text) - length(replace(d.text, ' ', '')) AS n_spaces,
               length(d.text) - length(replace(d.text, 'e', '')) AS n_e,
               length(d.text) - length(replace(d.text, 'a', '')) AS n_a
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "pred": """
        SELECT s.doc_id AS unit_id, s.source AS cluster, a.label, a.model, a.seed, a.kind,
               CASE WHEN a.label = 'quality' THEN s.quality ELSE s.toxic END AS y,
               (CASE WHEN a.model = 'length' THEN CASE WHEN a.kind = 'transferred' THEN s.n_chars ELSE s.n_spaces END
                     ELSE CASE WHEN a.kind = 'transferred' THEN s.n_e ELSE s.n_a END END
                * (CASE WHEN a.label = 'quality' THEN 1 ELSE -1 END) + (s.doc_id * 7 + a.seed * 13) % (5 + a.seed)) * 1e0 AS score
        FROM scored s CROSS JOIN (
            SELECT * FROM (VALUES ('quality'), ('toxic')) AS t1(label)
            CROSS JOIN (VALUES ('length'), ('letters')) AS t2(model)
            CROSS JOIN (VALUES (0), (1), (2)) AS t3(seed)
            CROSS JOIN (VALUES ('transferred'), ('oracle')) AS t4(kind)) a""",
    # --- model features -------------------------------------------------------------------
    "vectors": """
        SELECT vec_id AS stay_id, embedding, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y_low,
               CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS y_even, vec_id % 3 AS era, vec_id % 25 AS site
        FROM embeddings""",
}


def _seconds(sql: str, form: str) -> str:
    return re.sub(r"SECS\(((?:[^()]|\([^()]*\))*)\)", lambda m: form.format(m.group(1)), sql)


def spark_sql(sql: str) -> str:
    return _seconds(sql, "unix_timestamp(CAST({} AS TIMESTAMP))")


def check_sql(sql: str) -> str:
    return _seconds(sql, "CAST(floor(epoch({})) AS BIGINT)")


def needs(sql: str, names: list[str]) -> list[str]:
    """Names that occur after FROM or JOIN."""
    found = re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_]\w*)", sql)
    return [n for n in names if n in found]


def with_roles(body: str, extra: dict[str, str] | None = None) -> str:
    """Check statement: `body` with every role it needs as a common table expression."""
    known = {**ROLES, **(extra or {})}
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in needs(sql, list(known)):
            if n not in order:
                visit(known[n])
                order.append(n)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in order)
    return check_sql(f"WITH {ctes}\n{body.strip()}" if ctes else body.strip())


class Roles:
    """Role tables of one data folder as lazy frames: `Roles(spark, folder).chartevents`.

    The session's shuffles are sized by the rows of the given tables in use, which Parquet keeps in its footers.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}
        self._kept: set[str] = set()
        self._rows = 0

    def keep(self, name: str) -> Roles:
        """Write role table `name` to the shared folder at its first use; for one that several others are derived from."""
        self._kept.add(name)
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            make = lambda: self._read(name)
        elif name in ROLES:
            make = lambda: (cut_lineage if name in self._kept else lambda df: df)(self._derive(ROLES[name]))
        else:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = make()
        return self._frames[name]

    def _read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self._rows += table.count()
        size_shuffles(self.spark, self._rows)
        return table

    def _derive(self, sql: str) -> DataFrame:
        used = needs(sql, TABLES + list(ROLES))
        for n in used:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(spark_sql(sql), **{n: getattr(self, n) for n in used})
