"""Word lists and constants the results depend on.

All entries are fixed values: they must equal the published lists for results
to agree, so they are stated as they are and in their natural order.
"""

# Languages whose labels are left out of generated strings.
SKIPPED_LABEL_LANGUAGES = [
    "ja", "fa", "hi", "ko", "bn", "zh", "ml", "ru", "el", "kn", "gu", "mk", "ne", "te", "hy",
    "km", "ti", "kk", "th", "my", "uk", "pa", "bg", "ur", "vi", "ar", "sr", "he", "ta", "ka",
    "am", "mr", "lo", "mn", "be", "or", "ba", "si", "ky", "uz",
]
# Languages of strings that never get an institution.
BLOCKED_LANGUAGES = ["fa", "ko", "zh-cn", "zh-tw", "ja", "uk", "ru", "vi", "ar"]
# Upper-case surnames that mark author lists, and the words that make an exception.
SURNAMES = ["LIANG", "YANG", "LIU", "XIE", "JIA", "ZHANG"]
ORGANISATION_WORDS = [
    "Hospital", "University", "School", "Academy", "Institute", "Ministry", "Laboratory", "College",
]
VAGUE_STARTS = ["Dep", "School", "Ministry"]
# Registry states of institutions that no longer exist.
CLOSED_STATES = ["withdrawn", "inactive"]
# Names too general to match on.
BANNED_NAMES = ["UniversityHospital", "Coastal", "Brunswick", "Continental"]
# Extra names: the first rule that applies adds its name.
KNOWN_EXTRA_NAMES = [
    ("Harvard University", "Harvard Medical School"),
    ("University of Oxford", "Oxford University"),
]
DEPARTMENTS = [
    "Psychology", "Nephrology", "Other departments", "Other Departments", "Nursing & Midwifery",
    "Literature and Creative Writing", "Neuroscience", "Engineering", "Computer Science",
    "Chemistry", "Biology", "Medicine",
]
# Labelled-set names and their replacements.
DATASET_NAMES = {"gold_500": "gold_hard", "gold_1000": "gold_easy"}

# Ensemble constants and category names.
THRESHOLD = 0.99
SECOND_THRESHOLD = 0.01
STRING_MATCH_SCORE = 0.95
SECOND_COUNTRY = "China"
SECOND_PHRASE = "Natural Resource"
TOP_CANDIDATES = 20

# Beginnings of generated strings.
COLLEGE_SUBJECTS = [
    "Agriculture and Life Sciences", "Design", "Education", "Engineering",
    "Humanities and Social Sciences", "Natural Resources", "Management", "Sciences", "Textiles",
    "Veterinary Medicine", "Information Technology", "IT",
]
DEPARTMENT_SUBJECTS = [
    "Biology", "Applied Science", "Psychiatry", "Medicine", "Chemistry", "Physics",
    "Aerospace Engineering", "Electrical Engineering", "Civil Engineering", "Biochemistry",
    "Computer Science", "IT", "Thoracic and Cardiovascular Surgery", "Surgery",
    "Internal Medicine", "Information Technology", "Psychology", "Applied Mechanics",
    "Biological and Agricultural Engineering", "Biomedical Engineering",
    "Chemical and Biomolecular Engineering", "Civil, Construction and Environmental Engineering",
    "Environmental Engineering", "Industrial & Systems Engineering",
    "Electrical and Computer Engineering", "Materials Science and Engineering",
    "Mechanical and Aerospace Engineering", "Nuclear Engineering", "Biological Sciences",
    "Marine, Earth, and Atmospheric Sciences", "Mathematics", "Statistics", "Communication",
    "English", "Foreign Languages and Literatures", "History", "Interdisciplinary Studies",
    "Philosophy and Religious Studies", "Political Science", "Public Administration",
    "Social Work", "Sociology and Anthropology", "Agriculture",
]
SCHOOL_SUBJECTS = [
    "Natural Resources", "Dentistry", "Law", "Medicine", "Chemical Engineering & Technology",
    "Biochemistry", "Business", "Physics", "Engineering", "Economics", "Veterinary Medicine",
    "Textiles", "Education", "Design", "Information Technology",
]
HEALTHCARE_SUBJECTS = [
    "Endocrinology", "Orthopedic Surgery", "Medicine", "Dermatology", "Cardiology",
    "Clinical Laboratory Science", "Clinical Rehabilitation and Mental Health Counseling",
    "Occupational Science and Occupational Therapy", "Physician Assistant Studies",
    "Physical Therapy", "Radiologic Science", "Speech and Hearing Sciences", "Anesthesiology",
    "Emergency Medicine", "Family Medicine", "Neurology", "Neurosurgery",
    "Obstetrics and Gynecology", "Ophthalmology", "Orthopaedics",
    "Otolaryngology/Head & Neck Surgery", "Pathology and Laboratory Medicine", "Pediatrics",
    "Physical Medicine and Rehabilitation", "Psychiatry", "Radiation Oncology", "Radiology",
    "Surgery", "Urology",
]
COMPANY_TERMS = [
    "Research Center", "Center of Excellence", "Research Division", "Applied Sciences Division",
    "Center of Research",
]
COLLEGE_FORMATS = ["College of"]
DEPARTMENT_FORMATS = ["Department of", "Dep of", "Dept of", "Dep. of", "Dept. of"]
SCHOOL_FORMATS = ["School of", "Sch. of", "Sch of"]

# How often a prefix is drawn per place format, by kind of known place and type.
PREFIX_REPEATS = {
    "region": {"Education": 5, "Healthcare": 3, "Company": 2},
    "state": {"Education": 3, "Healthcare": 3, "Company": 1},
    "city": {"Education": 3, "Healthcare": 3, "Company": 1},
    "country": {"Education": 4, "Healthcare": 3, "Company": 1},
    "none": {"Education": 5, "Healthcare": 3, "Company": 2},
}
