"""Fixed values that must equal the study's for right results.

FIXED VALUES -- do not edit: group keys (column suffixes), their display
labels (the values stored in ``feature_group``), the ordered classifier
rules, the score cut points and the category order.
"""

from __future__ import annotations

# ---- fixed values: functional groups, in column order -------------------
GROUPS = [
    "grading", "modules", "discussions", "assignments", "quizzes",
    "navigation", "announcements", "people", "analytics", "admin", "otros",
]

# ---- fixed values: display label per group (stored in feature_group) ----
GROUP_LABELS = {
    "grading": "Evaluación y calificación",
    "modules": "Módulos y contenido",
    "discussions": "Debates y comunicación",
    "assignments": "Tareas y entregas",
    "quizzes": "Evaluaciones y tests",
    "navigation": "Navegación",
    "announcements": "Anuncios",
    "people": "Gestión de estudiantes",
    "analytics": "Analítica e informes",
    "admin": "Administración",
    "otros": "Otros",
}

# ---- fixed values: labels of the predictors that are not a group's rate or intensity ----
BEHAVIOUR_LABELS = {
    "clicks_per_session": "Clics por sesión",
    "n_sessions": "N.º de sesiones",
    "n_distinct_features": "Amplitud de uso (funcionalidades)",
    "log_total_clicks": "Volumen total (log)",
}

# ---- fixed values: classifier rules, first match wins -------------------
# Case-insensitive LIKE patterns per group, in rule order.  ``%`` = any text.
# The last group ("otros") has no pattern: it is the fallback.
CLASSIFIER_RULES = [
    ("grading", ["%speedgrader%", "%gradebook%", "%grade%", "Grades%", "%rubric%", "LMGB%"]),
    ("modules", ["%module%", "%syllabus%", "%rich content%", "RCE%", "%edit page%",
                 "%keep editing%", "%unpublish%", "%drag and drop%", "%files%", "%pages%",
                 "%import content%", "%import existing%", "%upload%", "%cover image%",
                 "%add section%", "%alt text%", "%block editor%", "Page>%", "%publish%"]),
    ("discussions", ["%discussion%", "%conversation%", "%compose%"]),
    ("assignments", ["%assignment%", "%submission%", "%date and time%", "%assign to%",
                     "%due date%", "%available from%"]),
    ("quizzes", ["NQ |%", "CQ |%", "AMS%", "%quiz%", "%question%", "%moderation%"]),
    ("navigation", ["%navigation%", "%dashboard%", "%course home page link%"]),
    ("announcements", ["%announcement%"]),
    ("people", ["%people%", "%roster%", "%student%", "%attendance%", "%group%", "%section%"]),
    ("analytics", ["%analytics%", "%insight%", "%report%"]),
    ("admin", ["%settings%", "Admin%", "Account%", "%outcomes%"]),
]
FALLBACK_GROUP = "otros"

# The notebook mirror of the rules matches "lmgb" anywhere instead of as a
# prefix; everything else is identical.
PYTHON_RULE_OVERRIDES = {"LMGB%": "%lmgb%"}

# ---- fixed values: score categories --------------------------------------
CATEGORIES = ["detractor", "passive", "promoter"]   # ordinal 0, 1, 2
DETRACTOR_MAX = 6
PASSIVE_MAX = 8

# Default look-back / session parameters of the study.
WINDOW_DAYS = 90
SESSION_GAP_MINUTES = 30
MIN_SESSION_LENGTH = 2
