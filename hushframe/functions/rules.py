"""Classes of personal data, how they look and are labelled, in three profiles.

``text`` reads character spans of HTML, ``runtime`` labelled boxes of a page, ``browser`` boxes of a live page. The
profiles differ on purpose and are never mixed.
"""

PROFILES = ("text", "runtime", "browser")

#: Shape of each class; the first that is found wins. The checksum of AADHAAR is tested apart.
_EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"
_AADHAAR = r"\b\d{4}\s?\d{4}\s?\d{4}\b"
_PAN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
_IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
_DOB = r"\b\d{2}[/-]\d{2}[/-](?:19|20)\d{2}\b"
_ACCOUNT = r"\b\d{11,16}\b"
_APPLICATION = r"\b(?:APP|REF|SCH|ADM)\d{6}\b"

PAGE_FORMATS = (
    ("EMAIL", _EMAIL),
    ("LICENCE", r"\b[A-Z]{2}\d{2}\s\d{11}\b"),
    ("VEHICLE", r"\b[A-Z]{2}\d{2}\s[A-Z]{2}\s\d{4}\b"),
    ("HEALTH_ID", r"\b\d{4}-\d{4}-\d{4}\b"),
    ("PATIENT_ID", r"\bPT\d{7}\b"),
    ("APPOINTMENT", r"\bAPT\d{6}\b"),
    ("PROPERTY_ID", r"\bPID\d{7}\b"),
    ("GRIEVANCE", r"\bGRV\d{6}\b"),
    ("EMPLOYEE_ID", r"\bEMP\d{5}\b"),
    ("APPLICATION", _APPLICATION),
    ("AADHAAR", _AADHAAR),
    ("PAN", _PAN),
    ("IFSC", _IFSC),
    ("DOB", _DOB),
    ("PHONE", r"(?:\+91[\s-]?)?\b[6-9]\d{9}\b"),
    ("ACCOUNT", _ACCOUNT),
)
TEXT_FORMATS = (
    ("EMAIL", _EMAIL),
    ("AADHAAR", _AADHAAR),
    ("PAN", _PAN),
    ("IFSC", _IFSC),
    ("PHONE", r"(?:\+91[\s-]?|\b0)?[6-9]\d{9}\b"),
    ("DOB", _DOB),
    ("ACCOUNT", _ACCOUNT),
    ("APPLICATION", _APPLICATION),
)
#: What every text with one of these shapes has in it.
SHAPED = "[0-9@]"
#: What every match of a pattern has in it, and quicker to look for in long texts.
NEEDS = {_EMAIL: "@", _ACCOUNT: "[0-9]{11}", _ACCOUNT.replace(r"\d", "[0-9]"): "[0-9]{11}", dict(TEXT_FORMATS)["PHONE"]: "[0-9]{10}", dict(PAGE_FORMATS)["PHONE"]: "[0-9]{10}", _AADHAAR: "[0-9]{4}", _PAN: "[0-9]{4}[A-Z]", _DOB: "[/-](?:19|20)[0-9]{2}"}
FORMATS = {"text": TEXT_FORMATS, "runtime": PAGE_FORMATS, "browser": PAGE_FORMATS}

#: Words of a label that hint at a class; the first class with one wins.
_IDS = (
    ("HEALTH_ID", ("health id", "abha")),
    ("PATIENT_ID", ("patient id",)),
    ("APPOINTMENT", ("appointment",)),
    ("PROPERTY_ID", ("property id",)),
    ("GRIEVANCE", ("grievance",)),
    ("EMPLOYEE_ID", ("employee id",)),
    ("LICENCE", ("licence", "license")),
    ("VEHICLE", ("vehicle", "registration no")),
)
HINTS = {
    "text": (
        ("AADHAAR", ("aadhaar", "aadhar", "uid")),
        ("PAN", ("pan",)),
        ("ACCOUNT", ("account number", "account no", "bank account")),
        ("IFSC", ("ifsc",)),
        ("EMAIL", ("email", "e-mail")),
        ("PHONE", ("mobile", "phone", "contact number")),
        ("DOB", ("date of birth", "dob", "birth")),
        ("ADDRESS", ("address", "residence")),
        ("PERSON", ("name", "applicant", "student", "candidate", "employee")),
        ("APPLICATION", ("application id", "application no", "reference id", "ref id")),
    ),
    "runtime": (
        ("AADHAAR", ("aadhaar", "aadhar", "uid")),
        ("PAN", ("pan",)),
        ("ACCOUNT", ("account",)),
        ("IFSC", ("ifsc",)),
        ("EMAIL", ("email", "e-mail")),
        ("PHONE", ("mobile", "phone")),
        ("DOB", ("date of birth", "dob")),
        ("PERSON", ("name", "applicant", "student", "candidate", "employee")),
        ("APPLICATION", ("application id", "application no", "reference")),
        ("ADDRESS", ("address",)),
        *_IDS,
    ),
    "browser": (
        ("AADHAAR", ("aadhaar", "aadhar", "uid")),
        ("PAN", ("pan",)),
        ("ACCOUNT", ("account",)),
        ("IFSC", ("ifsc",)),
        ("EMAIL", ("email", "e-mail")),
        ("PHONE", ("mobile", "phone")),
        ("DOB", ("date of birth", "dob")),
        ("ADDRESS", ("address",)),
        ("PERSON", ("name", "applicant", "student", "candidate", "employee", "patient", "holder")),
        ("APPLICATION", ("application id", "application no", "reference")),
        *_IDS,
    ),
}

ADDRESS = r"\b\d{1,4},\s?[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)*,\s?[A-Z][A-Za-z]+\s?-\s?\d{6}\b"
NAME = r"\b[A-Z][a-z]{2,11}\s[A-Z][a-z]{2,11}\b"
NOT_NAMES = {
    "runtime": (
        "Scholarship Status", "Download Certificate", "Application Summary", "Academic Year", "State Education",
        "Login Password", "Enter OTP", "National Scholarship", "Municipal Services", "District Health",
        "Employee Self", "Cooperative Bank", "Transport Department", "University Admissions", "Board", "Portal",
        "Records", "Service",
    ),
    "browser": (
        "Scholarship Status", "Download Certificate", "Application Summary", "Login Password", "Enter OTP",
        "Visit Status", "Permit Status", "Request Status", "Account Status", "Payroll Status", "Download Report",
        "Download Receipt", "Download Statement", "Download Payslip", "Download Permit", "Book Follow",
    ),
}
#: Least code points of free text that names and addresses are looked for in.
FREE_TEXT = {"runtime": 25, "browser": 12}

#: Classes that are blacked out instead of tokenised, and the order in which overlapping plan items win.
BLACKOUT = ("AADHAAR", "PAN", "ACCOUNT", "PASSWORD", "OTP")
PRIORITY = {
    "runtime": {0: ("PASSWORD", "OTP"), 1: ("AADHAAR", "PAN", "ACCOUNT"), 2: ("LICENCE", "VEHICLE", "HEALTH_ID", "ADDRESS")},
    "browser": {
        0: ("PASSWORD", "OTP"),
        1: ("AADHAAR", "PAN", "ACCOUNT"),
        2: ("LICENCE", "VEHICLE", "HEALTH_ID", "ADDRESS", "IMAGE_REGION"),
    },
}
OTHER_PRIORITY = 5

STOP_WORDS = ("the", "a", "an", "my", "our", "for", "to", "of", "in", "on", "and", "or", "please", "can", "you", "i", "me", "with", "from", "this", "that")

ACTIONABLE = ("button", "link", "textbox", "combobox", "checkbox", "radio")
PLANNED_ROLES = ("button", "link", "combobox", "textbox")
ACTIONS = ("CLICK", "TYPE", "SCROLL", "SELECT", "WAIT", "STOP")
RISK = {"SCROLL": "R0", "WAIT": "R0", "STOP": "R0", "SELECT": "R1", "CLICK": "R1", "TYPE": "R2"}
NEEDS_TARGET = ("CLICK", "TYPE", "SELECT")
PERSON_PHOTO = ("photo", "photograph", "avatar", "profile picture", "selfie", "portrait")
