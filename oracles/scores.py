"""Scored samples, run history and attributions in DuckDB form."""

from oracles import name

name(
    sc="""SELECT o_orderkey AS row_idx, o_custkey AS subject_id, CAST(1 + o_orderkey % 4 AS INT) AS cycle_number, o_orderdate AS prediction_time,
        CASE WHEN (o_orderkey * 31 + o_custkey) % 3 = 0 THEN 1 ELSE 0 END AS y, ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS p,
        lower(replace(o_orderpriority, ' ', '_')) AS variant, CAST(o_orderkey % 5 AS INT) AS seed, CAST(o_orderkey % 3 AS INT) AS task_id FROM orders""",
    att="""SELECT o_custkey AS subject_id, CAST(1 + l_orderkey % 7 AS INT) AS cycle_number, l_orderkey * 10 + l_linenumber AS position,
        CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'diagnosis::I500_ICDver10' ELSE 'diagnosis::4280_ICDver9' END
            WHEN 1 THEN 'lab::' || ['50912', '51006', '59999', '51222_Q1'][1 + CAST(l_suppkey % 4 AS INT)]
            WHEN 2 THEN 'medication::' || ['doxorubicin hcl', 'imatinib', 'trastuzumab emtansine conjugate'][1 + CAST(l_partkey % 3 AS INT)]
            ELSE '[CLS]' END AS token,
        l_extendedprice / 77777 AS rollout_score, abs(l_quantity - 25) / 25 AS ig_score_l2, l_quantity - 25 AS ig_score_signed,
        CAST(1 + l_suppkey % 6 AS INT) AS visit, -CAST(l_partkey % 400 AS DOUBLE) AS days_before FROM li""",
    att_named="""SELECT *, CASE WHEN token = '[CLS]' THEN 'special' ELSE split_part(token, '::', 1) END AS event_type,
        CASE split_part(token, '::', 1) WHEN 'lab' THEN 'lab:' || CASE split_part(token[6:], '_', 1) WHEN '50912' THEN 'Creatinine'
                WHEN '51006' THEN 'Urea Nitrogen' WHEN '51222' THEN 'Hemoglobin' ELSE split_part(token[6:], '_', 1) END
            WHEN 'diagnosis' THEN 'dx:' || split_part(split_part(token, '::', 2), '_', 1)
            WHEN 'medication' THEN 'rx:' || substring(split_part(token, '::', 2), 1, 22) ELSE token END AS label FROM att""",
)


def confusion(p: str, by: str, threshold: str, source: str = "sc") -> None:
    group = f"{by}, " if by else ""
    name(**{
        f"{p}_counts": f"""SELECT {group}sum(CASE WHEN p >= {threshold} AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
            sum(CASE WHEN p >= {threshold} AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN p < {threshold} AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
            sum(CASE WHEN p < {threshold} AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM {source} {'GROUP BY ' + by if by else ''}""",
        f"{p}_rates": f"""SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
            round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
            round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM {p}_counts""",
    })


def areas(p: str, by: str, source: str = "sc") -> None:
    """Area by average ranks, average precision by steps, log loss; one row per group."""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    name(**{
        f"{p}_ranks": f"SELECT {cols}y, rank() OVER ({part}ORDER BY p) + (count(*) OVER ({part.rstrip() + ', ' if by else 'PARTITION BY '}p) - 1) / 2.0::DOUBLE AS r FROM {source}",
        f"{p}_auc": f"""SELECT {cols}(sum(CASE WHEN y = 1 THEN r END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / nullif(sum(y)::DOUBLE * sum(1 - y), 0) AS auroc
            FROM {p}_ranks {group}""",
        f"{p}_steps": f"""SELECT {cols}p, sum(y) AS pos, sum(sum(y)) OVER ({part}ORDER BY p DESC) AS cp, sum(count(*)) OVER ({part}ORDER BY p DESC) AS ca
            FROM {source} GROUP BY {cols}p""",
        f"{p}_ap": f"SELECT {cols}sum(pos::DOUBLE * cp / ca) / nullif(sum(pos), 0) AS auprc FROM {p}_steps {group}",
        f"{p}_loss": f"""SELECT {cols}avg(CASE WHEN y = 1 THEN -ln(greatest(p, 2.220446049250313e-16::DOUBLE))
            ELSE -ln(greatest(1 - p, 2.220446049250313e-16::DOUBLE)) END) AS loss FROM {source} {group}""",
    })


confusion("cv", "variant", "0.5")
confusion("cw", "variant", "0.85")
confusion("ct", "task_id", "0.5")
confusion("cs", "variant, seed", "0.5")
confusion("cu", "variant, seed", "0.3")
areas("ga", "")
areas("gv", "variant")
areas("gt", "task_id")
areas("gs", "variant, seed")
name(
    runs="""SELECT variant, seed, tp, fp, fn, tn, auroc, auprc, loss, (SELECT 0) AS z FROM cs_counts JOIN gs_auc USING (variant, seed)
        JOIN gs_ap USING (variant, seed) JOIN gs_loss USING (variant, seed)""",
    run_values="""SELECT variant, seed, unnest(['auroc', 'auprc', 'f1', 'sensitivity', 'specificity', 'loss']) AS metric,
        unnest([auroc, auprc, 2 * tp / (2 * tp + fp + fn), tp / (tp + fn), tn / (tn + fp), loss]) AS value FROM runs""",
    hist="""SELECT variant, seed, CAST(1 + (row_idx * 7919) % (10 + seed) AS INT) AS epoch, avg(p) AS loss FROM sc GROUP BY ALL""",
    steps="""SELECT CAST(i * 0.05 AS DOUBLE) AS t0, round(i * 0.05::DOUBLE, 3) AS threshold FROM (SELECT unnest(range(1, 20)) AS i)""",
    sweep="""SELECT threshold, sum(CASE WHEN p >= threshold AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold AND y = 0 THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN p < threshold AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN p < threshold AND y = 0 THEN 1 ELSE 0 END) AS tn
        FROM sc, steps GROUP BY threshold""",
    swept="""SELECT threshold, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, round(tp / (tp + fn) + tn / (tn + fp) - 1, 9) AS youden,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS precision FROM sweep""",
)
