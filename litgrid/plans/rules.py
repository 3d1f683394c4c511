"""Rule data. Order matters wherever the first match wins."""

from __future__ import annotations

# They must equal those of published curation rules for results to agree.

MISSING_CELLS = ("nan", "na", "n/a", "none")

CURATED_COLUMNS = [
    "Name", "RecordID", "PaperIDX", "TableIDX", "Notes", "Stage_original", "Stage", "Analyses type", "Model type", "Meta/Joint",
    "SNP-based, Gene-based", "Cohort", "Cohort_simplified (no counts)", "Sample size", "Cases", "Controls", "Sample information",
    "Imputation_simple2", "Population", "Population_map", "Analysis group", "Phenotype", "Phenotype-derived",
    "For plotting Beta and OR - derived", "Reported gene (gene based test)", "TopSNP", "Interactions", "Chr", "P-value", "P-value note",
    "BP(Position)", "RA 1(Reported Allele 1)", "RA 2(Reported Allele 2)", "Note on alleles and AF", "ReportedAF(MAF)", "AFincases",
    "AFincontrols", "Effect Size Type (OR or Beta)", "EffectSize(altvsref)", "95%ConfidenceInterval",
    "Confirmed affected genes, causal variants, evidence", "Genome build (hg18/hg37/hg38)", "Pubmed PMID", "PMCID", "Table Ref in paper",
    "Table links", "LocusName",
]

SECTION_ALIASES = {
    "methods": ["methods", "materials and methods", "method", "patients and methods"],
    "results": ["results", "findings"],
    "supplement": ["supplement", "supplementary", "appendix"],
}

STAGE_CUES = {
    "meta-analysis": ["meta-analysis", "meta analysis", "inverse-variance", "fixed effect", "random effect", "metal"],
    "joint-analysis": ["joint analysis", "pooled", "combined genotype", "individual-level", "genotype data"],
    "stage 1": ["stage 1", "stage i"],
    "stage 2": ["stage 2", "stage ii"],
    "replication": ["replication", "validate", "validation", "confirm", "follow-up", "follow up", "independent cohort"],
    "discovery": ["discovery", "genome-wide", "gwas", "screen", "scan", "initial"],
}

IMPUTATION_WORDS = ["imput", "imputation", "imputed", "reference panel", "panel", "1000 genomes", "1000g", "phase 3", "p3", "HRC", "haplotype reference consortium", "topmed", "minimac", "eagle", "shapeit", "beagle", "michigan imputation server", "genotyping and imputation"]
STAGE_EVIDENCE = ["meta-analysis", "replication", "validation", "stage 1", "stage 2", "gwas"]
MODEL_EVIDENCE = ["logistic", "linear regression", "cox", "hazard ratio", "adjusted", "covariate", "principal components"]

ASSOCIATION_TYPES = {
    "Imaging": ["mri", "imaging", "ct", "pet", "dti", "wmh", "pvs", "hippocamp", "ventricle"],
    "Cognitive": ["cognitive", "memory", "mmse", "executive", "attention", "language", "processing speed"],
    "Fluid biomarker": ["csf", "plasma", "serum", "biomarker", "abeta", "tau", "ptau", "nfl"],
    "Neuropathology": ["neuropath", "braak", "cerad", "plaques", "tangles", "autopsy"],
    "Expression": ["eqtl", "expression", "transcript", "rna-seq", "bulk rna", "single cell"],
    "AD": ["alzheimer", "load", "ad case", "case-control", "disease risk"],
}

MODEL_FAMILIES = {
    "logistic": ["logistic regression", "logistic"],
    "linear": ["linear regression", "linear model"],
    "cox": ["cox", "proportional hazards", "hazard ratio", "survival"],
    "mixed": ["mixed model", "lmm", "gmmat", "saige", "bgenie"],
}

COVARIATES = ["adjust", "adjusted", "covariate", "age", "sex", "site", "batch", "pcs", "principal components", "ancestry", "education", "scanner"]

COHORTS = ["ADGC", "IGAP", "EADI", "GERAD", "CHARGE", "PENN", "ADNI", "AGES", "HRS", "ADSP"]

COHORT_SYNONYMS = {
    "amish": "Amish",
    "alzheimer's disease genetics consortium": "ADGC",
    "alzheimer’s disease genetics consortium": "ADGC",
    "adgc": "ADGC",
    "international genomics of alzheimer's project": "IGAP",
    "international genomics of alzheimer’s project": "IGAP",
    "igap": "IGAP",
    "eadi": "EADI",
    "gerad": "GERAD",
    "cohorts for heart and aging research in genomic epidemiology": "CHARGE",
    "charge": "CHARGE",
    "penn": "PENN",
    "alzheimer's disease neuroimaging initiative": "ADNI",
    "alzheimer’s disease neuroimaging initiative": "ADNI",
    "adni": "ADNI",
    "ages": "AGES",
    "health and retirement study": "HRS",
    "hrs": "HRS",
    "adsp": "ADSP",
}

ABBREVIATIONS = {
    "adgc": "Alzheimer's Disease Genetics Consortium",
    "igap": "International Genomics of Alzheimer's Project",
    "eadi": "European Alzheimer's Disease Initiative",
    "gerad": "Genetic and Environmental Risk in AD",
    "hrc": "Haplotype Reference Consortium",
    "topmed": "Trans-Omics for Precision Medicine",
    "1000g": "1000 Genomes",
    "maf": "minor allele frequency",
    "eaf": "effect allele frequency",
    "ea": "effect allele",
    "oa": "other allele",
}

IMPUTATION_CODES = {
    "haplotype reference consortium": "HRC",
    "hrc": "HRC",
    "trans-omics for precision medicine": "TOPMed",
    "topmed": "TOPMed",
    "1000 genomes": "1000G",
    "1000g": "1000G",
    "1000genomes": "1000G",
}

PAPER_HINTS = [
    ("35490390", None, "Population", "European ancestry"),
    ("35490390", None, "Imputation_simple2", "1000G;HRC"),
    ("35490390", 3, "Cohort", "Amish"),
]

COLUMN_PROMPTS = {
    "TopSNP": "Variant identifier, usually rsID. Example: rs429358",
    "Chr": "Chromosome label. Example: 19",
    "BP(Position)": "Base-pair position. Example: 45411941",
    "P-value": "Association p-value. Example: 2.4e-8",
    "EffectSize(altvsref)": "Effect estimate (OR/Beta/HR). Example: 1.23 or -0.08",
    "95%ConfidenceInterval": "Confidence interval for effect. Example: (1.10-1.37)",
    "RA 1(Reported Allele 1)": "Effect/minor allele. Example: C",
    "RA 2(Reported Allele 2)": "Other/major allele. Example: T",
    "ReportedAF(MAF)": "Allele frequency. Example: 0.27",
    "LocusName": "Nearest/reported gene symbol. Example: APOE",
    "Population": "Population ancestry descriptor. Example: European ancestry",
    "Cohort": "Cohort or consortium names. Example: ADGC;IGAP",
    "Sample size": "Total N or subgroup N. Example: 12345",
    "Imputation_simple2": "Imputation panel/method. Example: HRC;TOPMed",
    "Stage": "Study stage, e.g., Discovery/Replication/Meta-analysis",
    "Model type": "Statistical model family. Example: logistic regression",
}

# Words that must stand alone.
POPULATIONS = {
    "European ancestry": ["european ancestry", "european", "europeans"],
    "Asian ancestry": ["asian ancestry", "asian", "asians"],
    "African ancestry": ["african ancestry", "african", "africans"],
    "Hispanic/Latino ancestry": ["hispanic", "latino"],
    "Multi-ethnic": ["multi-ethnic", "multi ethnic", "trans-ethnic", "trans ethnic"],
}

PANELS = {"1000G": ["1000g", "1000 genomes", "1000genomes"], "HRC": ["hrc", "haplotype reference consortium"], "TOPMed": ["topmed"]}

SAMPLE_SIZES = [
    "(?i)\\b(?:sample size|total n|n\\s*=\\s*)(?:\\s*[:=]?\\s*)?([0-9][0-9,]{2,})\\b",
    "(?i)\\b([0-9][0-9,]{2,})\\s*(?:participants|subjects|individuals|cases|controls)\\b",
]

SUBHEADER_KEYWORDS = ["p value", "or", "beta", "β", "ci", "z-score", "hr", "se", "ea/oa", "snp", "chr:position", "effect", "frq"]
HEADER_KEYWORDS = "(?i)(snp|rsid|p\\s*-?value|beta|or|odds|chr|position|bp|allele|maf|ci)"
GENERIC_HEADER = "(?i)^(unnamed:?\\s*\\d*|col_\\d+|\\d+)$"

TABLE_PATTERNS = {
    "gene": ["\\bgene\\b", "\\bgenes\\b", "\\bgene symbol\\b", "\\bnearest gene\\b", "\\bmapped gene\\b", "\\blocus\\b", "\\brsid\\b", "\\brs\\d+\\b"],
    "p_value": ["\\bp[\\s\\-_]*value\\b", "\\bpvalue\\b", "\\bp-val\\b", "\\bmeta[- ]?p\\b", "\\bnominal p\\b", "\\badjusted p\\b", "\\bp for\\b", "(^|[\\s(])p([\\s)_:/-]|$)"],
    "effect": ["\\bor\\b", "\\bbeta\\b", "\\beffect\\b", "\\bhazard ratio\\b", "\\b95% ci\\b", "\\bci\\b"],
    "variant": ["\\bsnp\\b", "\\bvariant\\b", "\\bchr\\b", "\\bchromosome\\b", "\\bposition\\b"],
    "gene_count": ["\\bnumber of genes\\b", "\\bno\\.?\\s+of genes\\b", "\\bcount of genes\\b", "\\bgenes? overlapping\\b", "\\bgenes? enriched\\b", "\\bgenes? identified\\b", "\\bset of genes\\b"],
}

ROLE_PATTERNS = {
    "rs": ["snp (rs)", "variant (rs)", "snp all", "rs-id", "rsid", "snp", "marker"],
    "location": ["location and base pair change", "chr:position"],
    "chr": ["chr:position", "chr", "chromosome"],
    "bp": ["position", "bp", "base pair", "pos"],
    "locus": ["nearest gene", "closest gene", "nearestgene", "locusname", "locus name", "gene"],
    "maf": ["eaf", "maf", "af"],
    "cohort": ["cohort", "consortium", "study", "dataset", "sample set"],
    "imputation": ["imputation", "reference panel", "panel"],
    "population": ["population", "ancestry", "ethnicity"],
    "sample_size": ["sample size", "total n", "n=", "participants", "subjects"],
    "ea_oa": ["ea/oa", "ea / oa", "effect allele/other allele"],
    "a1a2maf": ["a1/a2", "a1/a2 a (maf)", "a1/a2a (maf)"],
    "major_minor": ["major/ minor alleles", "major/minor", "alleles", "allele"],
    "ci": ["95", "ci"],
    "interaction": ["interaction", "snp x", "snp*"],
}

# Roles told by ranked rules: (rank, what a normalised header must match, what it must not).
RANKED_ROLES = {
    "p": [
        (1, "p meta|meta p", None), (2, "p joint", None), (3, "p value all|p-value all", None), (4, "^(p|p-value|p value|pval)\\z|^p_|_p\\z", "pf"), (5, "p-value|p value", None),
        (6, "(?s)(?=.*(l\\s*o\\s*g\\s*(1\\s*0|_\\s*\\{\\s*1\\s*0\\s*\\}|\\(\\s*1\\s*0\\s*\\))|-\\s*l\\s*o\\s*g)).*\\bp\\b", None), (7, "\\bp\\b", "pf|het p"),
    ],
    "effect": [(1, "(?s)^(?=.*(beta|β))(?=.*( g|g\\z))", "x|×|interaction"), (2, "\\bor\\b|odds ratio", None), (3, "\\bbeta\\b|(?U)\\bβ\\b", None), (4, "\\bhr\\b|hazard ratio", None), (5, "\\bz[- ]?score\\b|\\bz\\b", None)],
    "a1": [(1, "a1", None), (2, "allele 1", None)],
    "a2": [(1, "a2", None), (2, "allele 2", None)],
    "variant": [(1, "^variant\\z", None), (2, "variant all|location and base pair change|chr:position", None), (3, "variant", None), (4, "location|change", None), (5, "snp \\(rs\\)|variant \\(rs\\)|snp all|rs-id|rsid|snp|marker", None)],
}

VALIDATED_FIELDS = ["TopSNP", "P-value", "EffectSize(altvsref)", "Chr", "BP(Position)", "RA 1(Reported Allele 1)", "Cohort_simplified (no counts)", "Sample size", "Imputation_simple2", "Population_map", "Analysis group", "Phenotype"]

STOP_TYPES = ["review", "systematic review", "meta-analysis", "editorial", "comment", "letter", "news"]
POSITIVE_MESH = ["alzheimer disease", "alzheimer's disease", "neurodegenerative diseases", "mild cognitive impairment", "amyloid beta-peptides", "tau proteins", "apolipoproteins e"]
GENETICS_HINTS = ["gene", "genes", "genetic", "genetics", "genome-wide association study", "gwas", "genome wide association", "variant", "variants", "locus", "risk allele", "polymorphism", "snp", "apoe", "mutation"]
TOPIC_HINTS = ["alzheimer", "alzheimers", "alzheimer's", "late-onset alzheimer", "dementia", "amyloid", "tau", "cognitive decline", "adni"]
TITLE_HINTS = ["gene", "genes", "genetic", "genetics", "gwas"]
