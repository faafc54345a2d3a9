"""They must equal the reference's for equal results. No logic here."""

# Patterns over report text (Python dialect; java() adapts them).
CLINICIAN = r"\b(?:dr|prof|professor)\b\.?\s*(?:[A-Z][\w.'-]*\s*){1,4}"
CREDENTIAL = r"\b(?:MBBS|FCPS|MCPS|DMRD|MRCR|RDMS|M\.?\s?Phil)\b"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE = r"(?:\+?88[\s-]?)?\b01[3-9]\d{2}[\s-]?\d{6}\b"
LONG_NUMBER = r"\b\d{6,}\b"
MONTH_STEMS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATE_IN_TEXT = (
    rf"\b\d{{1,2}}(?:st|nd|rd|th)?[\s\-/.,]*(?:{MONTH_STEMS})[a-z]*[\s\-/.,]*\d{{2,4}}\b"
    rf"|\b(?:{MONTH_STEMS})[a-z]*\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"
    r"|\b\d{1,2}[./\-]\d{1,2}[./\-](?:\d{4}|\d{2})\b|\b\d{4}-\d{1,2}-\d{1,2}\b"
)

# Layout of a report.
CELL_SEPARATORS = "[|\t\x07�]"
HEADER_LABEL = (
    r"(?<![A-Za-z])(id\s*no\.?|reg(?:istration)?\.?\s*no\.?|patient'?s?\s*name|name"
    r"|m(?:r|rs|iss|s)\.?\s*/\s*m(?:r|rs|iss|s)\.?(?:\s*/\s*[a-z]+\.?)?"
    r"|date|age|sex|gender|examined|examination)\s*:"
)
UNLABELLED_EXAM = r"^(?:hr)?ct\b.*\bof\b|^(?:mri|cta|ncct|cect)\b"
SECTION_WORDS = (
    r"clinical\s+(?:information|info|history|details)|history|technique|findings?"
    r"|impressions?|conclusion|opinion|advice|adv|suggestions?|n\.?\s?b\.?"
)
BULLET = r"^\s*(?:[o•\-*]\s+)?"
SIGNATURE = (
    r"^\s*(?:dr|prof|professor)\b\.?|\bMBBS\b|\bFCPS\b|\bM\.?\s?Phil\b|\bDMRD\b|\bMRCR\b|\bRDMS\b"
    r"|department\s+of\s+radiology|medical\s+university|university\s*,|resident\s*\(|phase\s*-?\s*[ab]\b"
    r"|medical\s+officer|consultant\s+radiologist|assistant\s+professor|associate\s+professor"
    r"|\btrainee\b|clinical\s+fellow"
)
TITLE_WORD = r"\bREPORT\b"
HEADER_LINES = 40

# Months, in calendar order, and the fuzzy cut-off.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_CUTOFF = 0.7

# The four date forms, in order of priority.
DATE_DAY_MONTH_YEAR = r"(\d{1,2})(?:st|nd|rd|th)?[\s,.\-/]*([A-Za-z]{3,})[\s,.\-/]*(\d{4}|\d{2})\b"
DATE_MONTH_DAY_YEAR = r"([A-Za-z]{3,})\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
DATE_ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
DATE_NUMERIC = r"\b(\d{1,2})[./\-](\d{1,2})[./\-](\d{4}|\d{2})\b"

# Examination classes.
MODALITY_CTA = r"\bcta\b|angiogra"
MODALITY_MRI = r"\bmri?\b|magnetic"
MODALITY_CT = r"\bct\b|\bcect\b|\bncct\b|computed"
MODALITY_XRAY = r"x[\s-]?ray"
CONTRAST_WITH = r"with\s+contrast|contrast[\s-]+enhanced|\bcect\b|\biv\s+contrast|after\s+iv|and\s+contrast"
CONTRAST_WITHOUT = r"non[\s-]*contrast|plain|without\s+contrast|\bncct\b"
REGIONS = {
    "brain/head": r"brain|head|cranial|skull|sella|pituitary",
    "chest": r"chest|thora|lung|pulmonary|mediastin",
    "abdomen": r"abdom|kub|liver|hepat|pancrea|renal|kidney|urogra|entero",
    "pelvis": r"pelvi",
    "neck": r"neck|thyroid|laryn|pharyn|parotid",
    "paranasal sinus": r"\bpns\b|sinus|nasal",
    "temporal bone/ear": r"temporal\s+bone|mastoid|\bear\b|\bhrct\s+of\s+(?:rt|lt|right|left|both)",
    "orbit": r"orbit",
    "spine": r"spin|vertebr|cervical|lumbar|dorsal|sacr",
    "extremity": r"knee|shoulder|hip|ankle|wrist|elbow|limb|extremit|femur|tibia|hand|foot",
    "vascular": r"angiogra|\bcta\b|aort|venogra",
}

# Name honorifics, stop words, thresholds.
TITLES = (
    "mr", "mrs", "ms", "miss", "md", "mohammad", "mohammed", "muhammad", "mohamed", "mohd", "mohammod", "muhammed", "mohamad", "mst", "most",
    "mosammat", "mossammat", "mosamat", "musammat", "mosammet", "dr", "prof", "late", "alhaj", "haji", "hajee", "hazi", "janab", "sri", "shri",
    "srimoti", "smt",
)
STOP_WORDS = (
    "the", "and", "with", "for", "are", "was", "were", "not", "seen", "noted", "both", "left", "right",
)
SIMILAR_NAME = 0.92
VOCABULARY_MIN_DOCS = 3

# DICOM tag groups.
REMOVE_TAGS = (
    "PatientBirthDate", "PatientBirthTime", "PatientAddress", "PatientTelephoneNumbers", "OtherPatientIDs", "OtherPatientIDsSequence",
    "OtherPatientNames", "PatientMotherBirthName", "MedicalRecordLocator", "IssuerOfPatientID", "AccessionNumber", "StudyID", "InstitutionName",
    "InstitutionAddress", "InstitutionalDepartmentName", "StationName", "DeviceSerialNumber", "RequestAttributesSequence",
    "AdmittingDiagnosesDescription", "AdditionalPatientHistory", "PatientComments", "ImageComments", "StudyComments", "CountryOfResidence",
    "RegionOfResidence", "Occupation", "PatientReligiousPreference", "PatientInsurancePlanCodeSequence", "MilitaryRank", "BranchOfService",
)
DATE_TAGS = (
    "StudyDate", "SeriesDate", "AcquisitionDate", "ContentDate",
)
UID_TAGS = (
    "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "FrameOfReferenceUID",
)
PIXEL_RISK_MODALITIES = (
    "US", "SC", "OT", "XC", "SR", "DOC",
)
OLE_FIELDS = (
    "author", "last_saved_by", "title", "subject", "keywords", "comments", "company", "manager",
)
OLE_MAGIC = "D0CF11E0A1B11AE1"

# Numbers of the elements that de-identification names, in the public DICOM dictionary.
TAG_NUMBERS = {
    "SOPInstanceUID": 0x00080018, "ImageType": 0x00080008, "StudyDate": 0x00080020, "SeriesDate": 0x00080021, "AcquisitionDate": 0x00080022,
    "ContentDate": 0x00080023, "AccessionNumber": 0x00080050, "Modality": 0x00080060, "InstitutionName": 0x00080080,
    "InstitutionAddress": 0x00080081, "ReferringPhysicianName": 0x00080090, "ConsultingPhysicianName": 0x0008009C, "StationName": 0x00081010,
    "StudyDescription": 0x00081030, "InstitutionalDepartmentName": 0x00081040, "PhysiciansOfRecord": 0x00081048,
    "PerformingPhysicianName": 0x00081050, "NameOfPhysiciansReadingStudy": 0x00081060, "OperatorsName": 0x00081070,
    "AdmittingDiagnosesDescription": 0x00081080, "ManufacturerModelName": 0x00081090, "PatientName": 0x00100010, "PatientID": 0x00100020,
    "IssuerOfPatientID": 0x00100021, "PatientBirthDate": 0x00100030, "PatientBirthTime": 0x00100032, "PatientSex": 0x00100040,
    "PatientInsurancePlanCodeSequence": 0x00100050, "OtherPatientIDs": 0x00101000, "OtherPatientNames": 0x00101001,
    "OtherPatientIDsSequence": 0x00101002, "PatientBirthName": 0x00101005, "PatientAge": 0x00101010, "PatientAddress": 0x00101040,
    "PatientMotherBirthName": 0x00101060, "MilitaryRank": 0x00101080, "BranchOfService": 0x00101081, "MedicalRecordLocator": 0x00101090,
    "CountryOfResidence": 0x00102150, "RegionOfResidence": 0x00102152, "PatientTelephoneNumbers": 0x00102154, "Occupation": 0x00102180,
    "AdditionalPatientHistory": 0x001021B0, "PatientReligiousPreference": 0x001021F0, "ResponsiblePerson": 0x00102297,
    "PatientComments": 0x00104000, "PatientIdentityRemoved": 0x00120062, "DeidentificationMethod": 0x00120063, "DeviceSerialNumber": 0x00181000,
    "StudyInstanceUID": 0x0020000D, "SeriesInstanceUID": 0x0020000E, "StudyID": 0x00200010, "FrameOfReferenceUID": 0x00200052,
    "ImageComments": 0x00204000, "BurnedInAnnotation": 0x00280301, "RequestingPhysician": 0x00321032, "StudyComments": 0x00324000,
    "ScheduledPerformingPhysicianName": 0x00400006, "RequestAttributesSequence": 0x00400275, "NamesOfIntendedRecipientsOfResults": 0x00401010,
    "OrderEnteredBy": 0x00402008, "HumanPerformerName": 0x00404037, "VerifyingObserverName": 0x0040A075, "PersonName": 0x0040A123,
    "ContentCreatorName": 0x00700084, "ROIInterpreter": 0x300600A6, "ReviewerName": 0x300E0008, "InterpretationRecorder": 0x40080102,
    "InterpretationTranscriber": 0x4008010A, "InterpretationAuthor": 0x4008010C, "PhysicianApprovingInterpretation": 0x40080114,
    "DistributionName": 0x40080119,
}

# Elements of value representation PN in the public DICOM dictionary, by keyword.
PERSON_NAME_TAGS = (
    "ConsultingPhysicianName", "ContentCreatorName", "DistributionName", "EvaluatorName", "HumanPerformerName", "InterpretationAuthor",
    "InterpretationRecorder", "InterpretationTranscriber", "NameOfPhysiciansReadingStudy", "NamesOfIntendedRecipientsOfResults",
    "OperatorsName", "OrderEnteredBy", "OtherPatientNames", "PatientBirthName", "PatientMotherBirthName", "PatientName",
    "PerformingPhysicianName", "PersonName", "PhysicianApprovingInterpretation", "PhysiciansOfRecord", "ReferringPhysicianName",
    "RequestingPhysician", "ResponsiblePerson", "ReviewerName", "ROIInterpreter", "ScheduledPerformingPhysicianName",
    "SecondaryReviewerName", "VerifyingObserverName",
)
# Elements of the same dictionary whose keyword sounds like a person's but that name a thing.
NO_PERSON_TAGS = (
    "ManufacturerModelName", "DetectorManufacturerModelName", "ChannelDerivationDescription", "ApplicationName", "BeamName", "CodingSchemeName",
    "ContextGroupName", "DeviceModelName", "DoseReferenceName", "FilterMaterialUsageName", "HangingProtocolName", "PulseSequenceName", "RTPlanName",
    "ScheduledStationName", "PerformedStationName", "SequenceName", "TreatmentMachineName", "StructureSetName", "TableName", "ROIName",
    "OperatorIdentificationSequence", "PersonIdentificationCodeSequence", "ReferringPhysicianIdentificationSequence",
    "PerformingPhysicianIdentificationSequence", "PhysiciansOfRecordIdentificationSequence", "RequestingPhysicianIdentificationSequence",
)
DEIDENTIFICATION_METHOD = "radveil: person names, private and listed tags removed, dates shifted, UIDs remapped"


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with Python's Unicode classes and case rules in Java's dialect."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern
