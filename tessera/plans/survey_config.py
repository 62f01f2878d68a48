"""Configuration of the two questionnaires (A and B).

The operators are generic; what makes them produce the same codes as the
original study are these scales, spellings and rules.  They are data, kept
together here.
"""

# --- fixed values -----------------------------------------------------------
# Yes/no spellings (table A accepts six, table B four).
YES_A = ["Si", "SI", "si"]
NO_A = ["No", "NO", "no"]
YES_B = ["Si", "SI"]
NO_B = ["No", "NO"]

# Satisfaction "Label (n)" → 0..5.
SATISFACTION_SCALE = {"Nulo (0)": 0, "Regular (1)": 1, "Aceptable (2)": 2,
                      "Medio (3)": 3, "Adecuado (4)": 4, "Pleno (5)": 5}

# Time to first job → 0..6 (two answers share code 5).
FIRST_JOB_SCALE = {
    "Estaba vinculado laboralmente antes de obtener el título": 0,
    "Menos de 1 mes": 1,
    "Entre 1 mes y 3 meses": 2,
    "Entre 3 meses y 6 meses": 3,
    "Entre 6 meses y 1 año": 4,
    "Entre 1 año y 2 años": 5,
    "Más de 1 año": 5,
    "Más de 2 años": 6,
}

# Relation of the job to the sector → 1..3.
SECTOR_SCALE = {"Nada relacionado": 1, "Relación Indirecta": 2, "Relación Directa": 3}

# Salary bands → 1..4 for undergraduate, specialisation and master's answers.
SALARY_UNDERGRAD = {"Menor a\xa0$ 2.100.000": 1, "Entre\xa0$2.100.000 y\xa0 $2.500.000": 2,
                    "Entre $2.500.000 y  $3.500.000": 3, "Mayor a $3.500.000": 4}
SALARY_SPECIALISATION = {"Menor a\xa0$ 3.000.000": 1, "Entre\xa0$3.000.000 y\xa0 $3.500.000": 2,
                         "Entre $3.500.000 y  $4.500.000": 3, "Mayor a $4.500.000": 4}
SALARY_MASTERS = {"Menor a\xa0$ 4.000.000": 1, "Entre\xa0$4.000.000 y\xa0 $4.500.000": 2,
                  "Entre $4.500.000 y  $5.000.000": 3, "Mayor a $5.000.000": 4}

# Job title keyword rules, first match wins, default level 3, level 0 → null.
JOB_LEVEL_RULES = [
    (0, ["no tengo empleo", "sin empleo", "sin trabajo", "no he conseguido",
         "aún no he conseguido", "no tengo trabajo", "no tengo", "ninguno",
         "na", "n/a"]),
    (1, ["auxiliar", "operativo", "asistente", "secretar", "cajera", "vendedor",
         "vendedora", "citador", "escribiente", "becaria", "practicante",
         "niñera", "empleada", "apoyo", "atención al usuario", "call center",
         "agente"]),
    (2, ["técnico", "tecnico", "analista", "junior", "dev", "investigador",
         "litigante", "abogada", "contratista", "independiente", "autonomo",
         "prestacion de servicios", "comerciante", "preparador"]),
    (3, ["profesional", "profesora", "docente", "interventor", "consultor",
         "asesor", "ejecutiva", "apoyo profesional"]),
    (4, ["coordinador", "coordinadora", "jefe", "supervisor", "directora del grado"]),
    (5, ["directivo", "directora", "director", "gerente", "manager",
         "senior", "autonomo, ordenador"]),
]
JOB_LEVEL_DEFAULT = 3

# Valid values of the nominal answers used by the correspondence analysis.
VALID_CATEGORIES = {
    "cat_genero": ["Masculino", "Femenino", "No binario"],
    "cat_sede": ["Bogotá", "Bucaramanga", "Villavicencio", "Tunja", "Medellín",
                 "Educación abierta y a distancia"],
    "cat_estado_civil": ["Soltero", "Casado", "Unión libre", "Separado", "Viudo",
                         "Vida Religiosa"],
    "cat_tipo_contrato": ["A término indefinido", "A término fijo",
                          "Por prestación de servicios", "Otro", "Contrato de aprendizaje"],
    "cat_recomendaria": ["Si", "No"],
    "cat_estudiaria_otra_vez": ["Si", "No", "No lo sabe"],
}

# Parents' education → five comparable classes.
PARENTS_EDUCATION = {
    "Ninguno": "Sin_estudios", "Primaria": "Basica", "Bachiller": "Media",
    "Técnico": "Tecnico", "Tecnólogo": "Tecnico", "Tecnólogo ": "Tecnico",
    "Profesional": "Universitario", "Especialización": "Posgrado",
    "Maestría": "Posgrado", "Doctorado": "Posgrado", "Posgrado": "Posgrado",
}

# Table B ordinal answers.
ATTAINMENT_SCALE = {"Muy bajo": 1, "Bajo": 2, "Medio": 3, "Alto": 4, "Muy alto": 5}
INCIDENCE_SCALE = {"No incidió": 0, "Muy bajo": 1, "Bajo": 2, "Medio": 3, "Alto": 4, "Muy alto": 5}
JOB_TYPE_SCALE = {"Operativo": 1, "Asistencial": 2, "Técnico": 3, "Profesional": 4, "Directivo": 5}
CONTRACT_SCALE = {
    "Contrato de aprendizaje": 1,
    "Contrato de prestación de servicios (por obra o labor)": 2,
    "Propietario de empresa": 3,
    "Contrato laboral a término fijo": 4,
    "Contrato laboral a término indefinido": 5,
}
AGREEMENT_SCALE = {"Totalmente en desacuerdo": 1, "En desacuerdo": 2,
                   "Ni de acuerdo ni en desacuerdo": 3, "De acuerdo": 4, "Totalmente de acuerdo": 5}
SUFFICIENCY_SCALE = {"Muy insuficientes": 1, "Insuficientes": 2,
                     "Ni suficientes ni insuficientes": 3, "Suficientes": 4, "Muy suficientes": 5}
INCOME_SCALE = {
    "Muy insuficiente (mis ingresos no me alcanzan para cubrir las necesidades básicas de mi hogar)": 1,
    "Insuficiente (mis ingresos no son suficientes para cubrir todas mis necesidades básicas)": 2,
    "Suficiente (mis ingresos cubren satisfactoriamente mis necesidades básicas, aunque no me permiten tener dinero adicional para usarlo como desee)": 3,
    "Muy suficiente (mis ingresos cubren mis necesidades básicas y me permiten tener dinero adicional para usarlo como desee)": 4,
}
EDUCATION_LEVEL_SCALE = {"Bachiller": 1, "Técnico": 2, "Tecnólogo": 3, "Profesional": 4,
                         "Especialista": 5, "Magister": 6, "Doctor": 7}

# Thresholds of the ingest stage.
SPARSE_COLUMN_THRESHOLD_A = 0.95
SPARSE_COLUMN_THRESHOLD_B = 0.90
INCOMPLETE_ROW_THRESHOLD = 0.90
SENTINEL_VALUE = 87
LIKERT_RANGE = (1, 5)
STRATUM_RANGE = (1, 6)
NOT_APPLICABLE = "No aplica"
RARE_CATEGORY_MIN = 10
RARE_CATEGORY_LABEL = "Otro"
SEGMENT_NAME_PREFIX = "Arquetipo "

# Composite clustering score weights: silhouette, Dunn, 1/(1+DB), 1/(1+cv).
SCORE_WEIGHTS = (0.35, 0.25, 0.25, 0.15)
# k selection: minimum smallest-segment share, then the relaxed share.
MIN_SHARE = 15.0
MIN_SHARE_RELAXED = 10.0
# --------------------------------------------------------------------------
