"""Field maps: which source columns give a typed column, what is left over, and whether a map still fits its source."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


@dataclass(frozen=True)
class Field:
    """Candidates for a column, the first that holds a value wins; and its type."""

    candidates: tuple[str, ...]
    type: str = "text"


class SourceChanged(ValueError):
    """A source no longer has the columns that a map can't do without."""


#: Share of a map's columns that a source should have; under it a warning says so.
LEAST_FIT = 0.5
TYPES = {"text": T.clean, "cnpj": T.company_number, "cd_cvm": T.company_code, "int": T.to_int, "numeric": T.to_decimal, "pct": T.to_decimal, "date": T.to_date, "bool": T.to_bool}

#: Each dataset's natural key.
DATASETS: dict[str, tuple[str, ...]] = {
    "fi_diario": ("cnpj", "dt_comptc", "id_subclasse"),
    "fi_cda": ("cnpj", "period", "tp_fundo", "tp_aplic", "tp_ativo", "cd_isin", "tp_negoc"),
    "fi_perfil": ("cnpj", "period"),
    "fi_balancete": ("cnpj", "dt_comptc", "cd_conta_balcte"),
    "fi_lamina": ("cnpj", "dt_comptc", "id_subclasse"),
    "fi_extrato": ("cnpj", "dt_comptc"),
    "fidc_mensal": ("cnpj", "period"),
    "fidc_tranche": ("cnpj", "period", "classe_serie"),
    "fidc_tranche_flows": ("cnpj", "period", "classe_serie", "tp_oper"),
    "fidc_aging": ("cnpj", "period"),
    "fidc_setor": ("cnpj", "period"),
    "fidc_scr": ("cnpj", "period"),
    "fidc_garantia": ("cnpj", "period"),
    "fidc_sacado": ("cnpj", "period", "seq"),
    "fidc_cedente": ("cnpj", "period", "bloco", "seq"),
    "fiagro_mensal": ("cnpj", "period"),
    "fii_geral": ("cnpj", "period", "doc_subtype", "versao"),
    "fii_complemento": ("cnpj", "period", "doc_subtype", "versao"),
    "fii_ativo_passivo": ("cnpj", "period", "doc_subtype", "versao"),
    "fii_periodic": ("cnpj", "doc_type", "period_year", "data_referencia", "versao"),
    "fii_imovel": ("cnpj", "data_referencia", "row_hash"),
    "securit_mensal": ("instrument_type", "codigo_identificacao", "dt_emissao", "occurrence"),
    "securit_serie": ("instrument_type", "codigo_identificacao", "data_referencia", "numero_serie", "classe", "occurrence"),
    "securit_fluxo": ("instrument_type", "cnpj_securit", "codigo_identificacao", "data_referencia"),
    "securit_dfin": ("instrument_type", "codigo_identificacao", "data_referencia", "occurrence"),
    "fund_registry": ("cnpj", "entity_type"),
    "registro_fundo": ("id_registro_fundo",),
    "registro_classe": ("id_registro_classe",),
    "registro_subclasse": ("id_registro_classe", "id_subclasse"),
    "cia_account": ("cd_cvm", "doc_type", "grupo", "escopo", "dt_refer", "ordem_exerc", "coluna_df", "dt_ini_exerc", "cd_conta", "versao"),
    "cia_filing": ("cd_cvm", "doc_type", "dt_refer", "versao"),
    "cia_event": ("protocolo", "versao"),
    "fi_cda_acoes": ("cnpj", "period", "tp_fundo", "tp_aplic", "tp_ativo", "cd_ativo", "tp_negoc"),
    "fi_cda_cotas": ("cnpj", "period", "tp_fundo", "cnpj_cota", "tp_aplic", "tp_negoc"),
    "fi_cda_debentures": ("cnpj", "period", "tp_fundo", "tp_aplic", "tp_ativo", "cpf_cnpj_emissor", "dt_venc", "tp_negoc", "row_hash"),
    "fii_trimestral_geral": ("cnpj", "doc_type", "period_year", "data_referencia", "versao"),
    "fii_trimestral_complemento": ("cnpj", "doc_type", "period_year", "data_referencia", "versao"),
    "fip_periodic": ("cnpj", "doc_type", "period", "classe_cota", "row_hash"),
    "cia_company": ("cd_cvm",),
    "cia_composicao_capital": ("cnpj_cia", "doc_type", "dt_refer", "versao"),
    "cia_fca_valor_mobiliario": ("cnpj_cia", "data_refer", "versao", "valor_mobiliario", "codneg", "mercado", "sigla_classe", "dt_inicio_neg", "dt_inicio_list"),
    "cia_fre_capital_social": ("cnpj_cia", "data_refer", "versao", "id_capital_social"),
    "cia_fre_distribuicao_capital": ("cnpj_cia", "data_refer", "versao"),
    "cia_fre_outro_valor_mobiliario": ("cnpj_cia", "data_refer", "versao", "id_documento", "row_hash"),
    "oferta_distrib_160": ("numero_requerimento",),
    "oferta_distrib_400": ("numero_registro_oferta", "serie"),
}
#: Columns with other names in the sources, by candidates; prefixes of source columns and their types.
RENAMED: dict[str, tuple[str, ...]] = {"cnpj": ("CNPJ_FUNDO_CLASSE", "CNPJ_FUNDO", "CNPJ_CIA", "CNPJ_CLASSE"), "period": ("DT_COMPTC", "DATA_REFERENCIA"), "tp_fundo": ("TP_FUNDO_CLASSE", "TP_FUNDO")}
PREFIXES: dict[str, str] = {"CNPJ": "cnpj", "CD_CVM": "cd_cvm", "CODIGO_CVM": "cd_cvm", "DT": "date", "DATA": "date", "VL": "numeric", "VALOR": "numeric", "QT": "numeric", "CAPTC": "numeric", "RESG": "numeric", "PR": "pct", "NR": "int", "VERSAO": "int", "PATRIMONIO": "numeric"}
#: Columns whose names the rule can't tell, by dataset.
_REF = ("Data_Referencia", "DT_COMPTC")
OWN: dict[str, dict[str, Field]] = {
    "fiagro_mensal": {
        "cnpj": Field(("CNPJ_Classe", "CNPJ_Fundo_Classe", "CNPJ_FUNDO_CLASSE", "CNPJ_FUNDO"), "cnpj"),
        "period": Field(_REF, "date"),
        "tp_fundo": Field(("Tipo_Fundo_Classe", "TP_FUNDO_CLASSE")),
        "vl_total": Field(("Valor_Ativo", "VL_TOTAL", "VL_CARTEIRA_TOTAL"), "numeric"),
        "vl_quota": Field(("Valor_Patrimonial_Cotas", "VL_QUOTA"), "numeric"),
        "vl_patrim_liq": Field(("Patrimonio_Liquido", "VL_PATRIM_LIQ", "TAB_IV_A_VL_PL"), "numeric"),
        "vl_inadimpl": Field(("Vencidos", "TAB_VI_B_VL_DIRCRED_INAD", "TAB_VI_B_VL_TOTAL", "TAB_VI_VL_TOTAL_INAD"), "numeric"),
        "nr_cotst": Field(("Numero_Cotistas", "NR_COTST"), "int"),
    },
    "fii_complemento": {
        "cnpj": Field(("CNPJ_Fundo_Classe", "CNPJ_FUNDO_CLASSE", "CNPJ_Fundo"), "cnpj"),
        "period": Field(_REF, "date"),
        "versao": Field(("Versao",)),
        "vl_patrim_liq": Field(("Patrimonio_Liquido", "VL_PATRIM_LIQ"), "numeric"),
        "vl_ativo": Field(("Valor_Ativo",), "numeric"),
        "cotas_emitidas": Field(("Cotas_Emitidas",), "numeric"),
        "vl_patrimonial_cotas": Field(("Valor_Patrimonial_Cotas",), "numeric"),
        "nr_cotst": Field(("Total_Numero_Cotistas",), "int"),
        "pct_rentab_efetiva_mes": Field(("Percentual_Rentabilidade_Efetiva_Mes",), "pct"),
        "pct_rentab_patrimonial": Field(("Percentual_Rentabilidade_Patrimonial_Mes",), "pct"),
        "pct_dividend_yield_mes": Field(("Percentual_Dividend_Yield_Mes",), "pct"),
        "pct_amortizacao_mes": Field(("Percentual_Amortizacao_Cotas_Mes",), "pct"),
    },
    "fund_registry": {
        "cnpj": Field(("CNPJ_FUNDO_CLASSE", "CNPJ_FUNDO", "CNPJ_Classe", "CNPJ_Fundo"), "cnpj"),
        "fund_name": Field(("DENOM_SOCIAL", "NM_FUNDO", "Denominacao_Social")),
        "status": Field(("SIT", "SITUACAO", "Situacao")),
        "tp_fundo": Field(("TP_FUNDO_CLASSE", "TP_FUNDO", "Tipo_Classe", "Tipo_Fundo")),
        "dt_reg": Field(("DT_REG", "DT_CONST", "Data_Registro"), "date"),
        "dt_cancel": Field(("DT_CANCEL", "Data_Cancelamento"), "date"),
        "admin_cnpj": Field(("CNPJ_ADMIN", "CNPJ_Administrador"), "cnpj"),
        "admin_name": Field(("ADMIN", "Administrador")),
        "gestor_id": Field(("CPF_CNPJ_GESTOR", "CPF_CNPJ_Gestor")),
        "gestor_name": Field(("GESTOR", "Gestor")),
        "vl_patrim_liq": Field(("Patrimonio_Liquido", "VL_PATRIM_LIQ"), "numeric"),
        "dt_patrim_liq": Field(("Data_Patrimonio_Liquido", "DT_PATRIM_LIQ"), "date"),
        "taxa_adm": Field(("TAXA_ADM",), "numeric"),
        "taxa_perfm": Field(("TAXA_PERFM",), "numeric"),
    },
}
_BANDS = (30, 60, 90, 120, 150, 180, 360, 720, 1080)


def _aging() -> dict[str, Field]:
    """Bands of days to maturity (A) and overdue (B): a number, a letter or a span of days names one, by year."""
    out = {}
    for letter, kind, long_ in (("A", "PRAZO", "PRAZO_VENC"), ("B", "INAD", "INAD")):
        low = 0
        for k, high in enumerate((*_BANDS, None), 1):
            name, span = (f"{high}", f"{low + 1}_{high}") if high else (f"MAIOR_{low}", f"MAIS_{low}")
            out[f"vl_{kind}_{name}".lower()] = Field((f"TAB_VI_{letter}{k}_VL_{long_}_{name}", f"TAB_VI_{letter}_VL_{k}", f"TAB_VI_VL_{kind}_{span}"), "numeric")
            low = high or low
    return out | {"vl_total_inad": Field(("TAB_VI_B_VL_DIRCRED_INAD", "TAB_VI_B_VL_TOTAL", "TAB_VI_VL_TOTAL_INAD"), "numeric")}


def _ratings() -> dict[str, Field]:
    """Value by rating of the debtor and of the operation."""
    grades = ("AA", *"ABCDEFGH")
    return {f"vl_{kind}_{g}".lower(): Field((f"TAB_X_SCR_RISCO_{kind}_{g}",), "numeric") for kind in ("DEVEDOR", "OPER") for g in grades} | {"vl_debito_tribut": Field(("TAB_X_DEBITO_TRIBUT",), "numeric")}


def _payments() -> dict[str, Field]:
    """What a certificate received and paid, by class, principal and interest."""
    out = {
        "cnpj_securit": Field(("CNPJ_Emissora", "CNPJ_Securitizadora", "CNPJ_securit", "CNPJ_FUNDO", "CNPJ"), "cnpj"),
        "codigo_identificacao": Field(("Codigo_Identificacao_Certificado", "Codigo_Identificacao")),
        "data_referencia": Field(("Data_Referencia", "DT_COMPETENCIA"), "date"),
        "recebimentos_direitos_creditorios": Field(("Recebimentos_Direitos_Creditorios", "Recebimentos_Creditos"), "numeric"),
        "pagamentos_despesas": Field(("Pagamentos_Despesas",), "numeric"),
        "pagamentos_classe_senior": Field(("Pagamentos_Classe_Senior",), "numeric"),
        "variacao_liquida_caixa": Field(("Variacao_Liquida_Caixa",), "numeric"),
    }
    for name, long_ in (("senior", "Senior"), ("mezanino", "Subordinada_Mezanino"), ("junior", "Subordinada_Junior")):
        base = f"Pagamentos_Classe_{long_}"
        short = [("Pagamentos_Senior_Principal",), ("Pagamentos_Senior_Juros",)] if name == "senior" else [(), ()]
        if name != "senior":
            out[f"pagamentos_{name}"] = Field((base,), "numeric")
        out[f"pagamentos_{name}_principal"] = Field((f"{base}_Amortizacao_Principal", f"{base}_Principal", *short[0]), "numeric")
        out[f"pagamentos_{name}_juros"] = Field((f"{base}_Juros", *short[1]), "numeric")
    return out


OWN |= {"fidc_aging": _aging(), "fidc_scr": _ratings(), "securit_fluxo": _payments()}
_TAB = re.compile(r"^TAB_[IVX]+(?:_\d+)?_(?:([A-Z]\d?)_)?(VL|PR|QT|NR)_(.+)$")


def _plain(name: str) -> str:
    return name.strip().lower().replace(" ", "")


def by_rule(dataset: str, header: Sequence[str]) -> dict[str, Field]:
    """The field map of a dataset for a header: the columns that OWN names, key columns by their known candidates, every other column by its own name
    in lower case (tab columns lose the tab, and their letter code follows the kind), typed by its prefix."""
    out: dict[str, Field] = dict(OWN.get(dataset, {}))
    taken = {_plain(n) for f in out.values() for n in f.candidates}
    for c in DATASETS[dataset]:
        if c in out:
            continue
        names = RENAMED.get(c, (c.upper(),))
        out[c] = Field(names, _type(names[0]))
        taken |= {_plain(n) for n in names}
    for h in header:
        if _plain(h) in taken:
            continue
        tab = _TAB.match(h.strip().upper())
        name = "_".join(x for x in (tab[2], tab[1], tab[3]) if x).lower() if tab else _plain(h)
        out.setdefault(name, Field((h,), _type(tab[2] if tab else h.strip().upper())))
    return out


def _type(name: str) -> str:
    return next((kind for prefix, kind in PREFIXES.items() if name == prefix or name.startswith(prefix + "_")), "text")


def coverage(header: Iterable[str], fields: Mapping[str, Field]) -> tuple[list[str], list[str]]:
    """(columns with a candidate in the header, columns without), ignoring case and blanks."""
    known = {_plain(h) for h in header}
    found = [c for c, f in fields.items() if any(_plain(x) in known for x in f.candidates)]
    return found, [c for c in fields if c not in found]


def fit(header: Iterable[str], fields: Mapping[str, Field]) -> float:
    """The share of columns that have a candidate in the header; 1 if there are no columns."""
    return len(coverage(header, fields)[0]) / len(fields) if fields else 1.0


def mapped(rows: DataFrame, fields: Mapping[str, Field], dataset: str = "", required: Sequence[str] = (), residual: str = "raw") -> DataFrame:
    """``rows`` as typed columns, and what no candidate used as a map of text, nulls too.

    A column is the first candidate with a value (not empty, NULL or NA); without one it's null. A missing required
    column raises: every row would be dropped in silence otherwise. A candidate counts as used in the rows where it won."""
    found, missing = coverage(rows.columns, fields)
    if fit(rows.columns, fields) < LEAST_FIT:
        warnings.warn(f"{dataset}: only {len(found)} of {len(fields)} columns have a candidate in the source", stacklevel=2)
    lost = [c for c in required if c in missing]
    if lost:
        raise SourceChanged(f"{dataset}: no column for {', '.join(lost)} in {', '.join(rows.columns[:12])}")
    real = {_plain(c): c for c in rows.columns}
    out, used = [], {c: F.lit(False) for c in rows.columns}
    for name, field in fields.items():
        own = [real[_plain(x)] for x in field.candidates if _plain(x) in real]
        chosen: Column = F.lit(None).cast("string")
        open_ = F.lit(True)
        for c in own:
            holds = F.col(f"`{c}`").isNotNull() & ~F.trim(f"`{c}`").isin("", "NULL", "NA")
            chosen = F.coalesce(chosen, F.when(holds, F.col(f"`{c}`")))
            used[c] = used[c] | (open_ & F.coalesce(holds, F.lit(False)))
            open_ = open_ & ~F.coalesce(holds, F.lit(False))
        out.append(TYPES[field.type](chosen).alias(name))
    left = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v"), used[c].alias("u")) for c in rows.columns]), lambda x: ~x["u"])
    rest = F.map_from_arrays(F.transform(left, lambda x: x["k"]), F.transform(left, lambda x: x["v"]))
    return rows.select(*out, rest.alias(residual))
