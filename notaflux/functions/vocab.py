"""Vocabularies of Brazilian clinical notes: data that results are defined by.

All values below are fixed values, stated as text: an entry a line, or separated by commas.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

# abbreviation = expansion.
ABBREVIATION_TEXT = """
HAS = Hipertensao Arterial Sistemica
IAM = Infarto Agudo do Miocardio
ICC = Insuficiencia Cardiaca Congestiva
FA = Fibrilacao Atrial
DAC = Doenca Arterial Coronariana
IC = Insuficiencia Cardiaca
AVC = Acidente Vascular Cerebral
AVCi = Acidente Vascular Cerebral Isquemico
AVCh = Acidente Vascular Cerebral Hemorragico
TVP = Trombose Venosa Profunda
TEP = Tromboembolismo Pulmonar
PA = Pressao Arterial
PAS = Pressao Arterial Sistolica
PAD = Pressao Arterial Diastolica
FC = Frequencia Cardiaca
ECG = Eletrocardiograma
EAP = Edema Agudo de Pulmao
DM = Diabetes Mellitus
DM1 = Diabetes Mellitus Tipo 1
DM2 = Diabetes Mellitus Tipo 2
HbA1c = Hemoglobina Glicada
TSH = Hormonio Tireoestimulante
T3 = Triiodotironina
T4 = Tiroxina
T4L = Tiroxina Livre
IMC = Indice de Massa Corporal
GJ = Glicemia de Jejum
DPOC = Doenca Pulmonar Obstrutiva Cronica
SDRA = Sindrome do Desconforto Respiratorio Agudo
IOT = Intubacao Orotraqueal
VM = Ventilacao Mecanica
VNI = Ventilacao Nao Invasiva
FR = Frequencia Respiratoria
SpO2 = Saturacao Periferica de Oxigenio
SatO2 = Saturacao de Oxigenio
O2 = Oxigenio
IRPA = Insuficiencia Respiratoria Aguda
DRGE = Doenca do Refluxo Gastroesofagico
DII = Doenca Inflamatoria Intestinal
RCU = Retocolite Ulcerativa
DC = Doenca de Crohn
EDA = Endoscopia Digestiva Alta
TGO = Transaminase Glutamico-Oxalacetica
TGP = Transaminase Glutamico-Piruvica
GGT = Gama Glutamil Transferase
FA_hepat = Fosfatase Alcalina
BT = Bilirrubina Total
BD = Bilirrubina Direta
BI = Bilirrubina Indireta
IRC = Insuficiencia Renal Cronica
IRA = Insuficiencia Renal Aguda
DRC = Doenca Renal Cronica
TFG = Taxa de Filtracao Glomerular
HD = Hemodialise
ITU = Infeccao do Trato Urinario
EAS = Elementos Anormais e Sedimento
TCE = Traumatismo Cranioencefalico
HIC = Hipertensao Intracraniana
TC = Tomografia Computadorizada
RNM = Ressonancia Nuclear Magnetica
RM = Ressonancia Magnetica
EEG = Eletroencefalograma
LCR = Liquido Cefalorraquidiano
SNC = Sistema Nervoso Central
HB = Hemoglobina
HT = Hematocrito
VCM = Volume Corpuscular Medio
HCM = Hemoglobina Corpuscular Media
CHCM = Concentracao de Hemoglobina Corpuscular Media
RDW = Indice de Anisocitose
PLT = Plaquetas
TP = Tempo de Protrombina
INR = Indice Normalizado Internacional
TTPA = Tempo de Tromboplastina Parcial Ativada
PCR = Proteina C Reativa
VHS = Velocidade de Hemossedimentacao
PTI = Purpura Trombocitopenica Idiopatica
CIVD = Coagulacao Intravascular Disseminada
HIV = Virus da Imunodeficiencia Humana
SIDA = Sindrome da Imunodeficiencia Adquirida
TB = Tuberculose
BAAR = Bacilo Alcool-Acido Resistente
ATB = Antibiotico
MRSA = Staphylococcus Aureus Resistente a Meticilina
AAS = Acido Acetilsalicilico
IECA = Inibidor da Enzima Conversora de Angiotensina
BRA = Bloqueador do Receptor de Angiotensina
BCC = Bloqueador dos Canais de Calcio
BB = Betabloqueador
HCTZ = Hidroclorotiazida
MTX = Metotrexato
AZT = Zidovudina
AINE = Anti-Inflamatorio Nao Esteroidal
IBP = Inibidor de Bomba de Protons
NPH = Neutral Protamine Hagedorn
EV = Endovenoso
VO = Via Oral
IM = Intramuscular
SC = Subcutaneo
SL = Sublingual
IT = Intratecal
GT = Gotas
CP = Comprimido
CPR = Comprimidos
AMP = Ampola
SOL = Solucao
SUS = Suspensao
POM = Pomada
BID = Duas Vezes ao Dia
TID = Tres Vezes ao Dia
QID = Quatro Vezes ao Dia
SOS = Se Necessario
ACM = A Criterio Medico
MID = Membro Inferior Direito
MIE = Membro Inferior Esquerdo
MSD = Membro Superior Direito
MSE = Membro Superior Esquerdo
QP = Queixa Principal
HDA = Historia da Doenca Atual
HPP = Historia Patologica Pregressa
HF = Historia Familiar
ISDA = Interrogatorio Sobre os Diversos Aparelhos
EF = Exame Fisico
HD_diag = Hipotese Diagnostica
CD = Conduta
Dx = Diagnostico
Rx = Prescricao
Sx = Sintomas
Tx = Tratamento
Hx = Historia
UTI = Unidade de Terapia Intensiva
PS = Pronto-Socorro
CC = Centro Cirurgico
PA_emerg = Pronto Atendimento
REG = Regular
BEG = Bom Estado Geral
MEG = Mau Estado Geral
LOTE = Lucido Orientado no Tempo e Espaco
LOTEP = Lucido Orientado no Tempo Espaco e Pessoa
MV = Murmúrio Vesicular
BRNF = Bulhas Ritmicas Normofoneticas
RHA = Ruidos Hidroaereos
MMII = Membros Inferiores
MMSS = Membros Superiores
HMG = Hemograma
BQ = Bioquimica
Na = Sodio
K = Potassio
Ca = Calcio
Mg = Magnesio
Cr = Creatinina
Ur = Ureia
AG = Gasometria Arterial
LDH = Desidrogenase Latica
CPK = Creatina Fosfoquinase
CK-MB = Creatina Quinase MB
BNP = Peptideo Natriuretico Cerebral
D-dimero = D-Dimero
VDRL = Venereal Disease Research Laboratory
FAN = Fator Antinuclear
PSA = Antigeno Prostatico Especifico
AFP = Alfafetoproteina
CEA = Antigeno Carcinoembrionario
CA-125 = Antigeno CA 125
CA-19.9 = Antigeno CA 19.9
PO = Pos-Operatorio
POI = Pos-Operatorio Imediato
RX = Radiografia
USG = Ultrassonografia
PET = Tomografia por Emissao de Positrons
AngioTC = Angiotomografia
ECO = Ecocardiograma
PAAF = Puncao Aspirativa por Agulha Fina
BX = Biopsia
QT = Quimioterapia
RT = Radioterapia
"""

# Medications.
MEDICATION_TEXT = """
losartana, losartan, enalapril, captopril, metformina, insulina, omeprazol, pantoprazol, amoxicilina, azitromicina,
ciprofloxacino, cefalexina, dipirona, paracetamol, ibuprofeno, diclofenaco, prednisona, prednisolona, dexametasona,
hidrocortisona, furosemida, espironolactona, sinvastatina, atorvastatina, rosuvastatina, clopidogrel, varfarina,
heparina, enoxaparina, metoprolol, atenolol, propranolol, carvedilol, anlodipino, nifedipino, diltiazem, verapamil,
levotiroxina, amiodarona, digoxina, clonazepam, diazepam, fluoxetina, sertralina, escitalopram, risperidona, haloperidol,
quetiapina, gabapentina, pregabalina, tramadol, morfina, codeina, metoclopramida, ondansetrona, ranitidina, bromoprida,
domperidona, salbutamol, fenoterol, budesonida, beclometasona, formoterol, tiotropio, metronidazol, fluconazol,
aciclovir, oseltamivir, ceftriaxona, meropenem, vancomicina, gentamicina, sulfametoxazol, trimetoprima, clindamicina,
doxiciclina, rifampicina, isoniazida, pirazinamida, etambutol, glibenclamida, glimepirida, sitagliptina, empagliflozina,
dapagliflozina, liraglutida, semaglutida, pioglitazona, alopurinol, colchicina, metotrexato, ciclofosfamida, tacrolimo,
micofenolato, azatioprina
"""

# Conditions.
CONDITION_TEXT = """
hipertensao, diabetes, pneumonia, infarto, insuficiencia, arritmia, fibrilacao, taquicardia, bradicardia, anemia,
trombose, embolia, isquemia, hemorragia, infeccao, sepse, choque, edema, dispneia, tosse, febre, cefaleia, dor, nausea,
vomito, diarreia, constipacao, ictericia, ascite, cianose, hipotensao, hipoglicemia, hiperglicemia, hipercalemia,
hipocalemia, acidose, alcalose, desidratacao, obesidade, desnutricao, insuficiencia renal, insuficiencia hepatica,
insuficiencia cardiaca, insuficiencia respiratoria, doenca pulmonar obstrutiva cronica, asma, bronquite, tuberculose,
meningite, encefalite, acidente vascular, epilepsia, convulsao, parkinson, alzheimer, demencia, depressao, ansiedade,
esquizofrenia, hipotireoidismo, hipertireoidismo, cirrose, hepatite, pancreatite, colecistite, apendicite, diverticulite,
gastrite, ulcera, neoplasia, tumor, cancer, leucemia, linfoma, fratura, luxacao, entorse, artrite, artrose, osteoporose,
lupus, covid-19, sars-cov-2, dengue, malaria
"""

# Procedures.
PROCEDURE_TEXT = """
cirurgia, biopsia, endoscopia, colonoscopia, broncoscopia, laparoscopia, tomografia, ressonancia, radiografia,
ultrassonografia, ecografia, ecocardiograma, cateterismo, angioplastia, revascularizacao, transplante, dialise,
hemodialise, intubacao, traqueostomia, drenagem, paracentese, toracocentese, puncao, aspiracao, transfusao,
quimioterapia, radioterapia, imunoterapia, fisioterapia, fonoterapia, nutricao enteral, nutricao parenteral, sutura,
desbridamento, amputacao, artroscopia, artrodese, mastectomia, colecistectomia, apendicectomia, histerectomia,
prostatectomia, nefrectomia, gastrectomia, colostomia, ileostomia, hemograma, gasometria, urocultura, hemocultura,
eletrocardiograma, holter, mapa
"""

# Entity types with labels, colour and the FHIR resource they become (none for dosages).
ENTITY_TYPES = (
    ("MEDICAMENTO", "Medicamento", "Medication", "#4CAF50", "MedicationStatement"),
    ("DOSAGEM", "Dosagem", "Dosage", "#2196F3", None),
    ("CONDICAO", "Condicao Clinica", "Medical Condition", "#F44336", "Condition"),
    ("PROCEDIMENTO", "Procedimento", "Procedure", "#FF9800", "Procedure"),
    ("VALOR_LABORATORIAL", "Valor Laboratorial", "Lab Value", "#9C27B0", "Observation"),
)
DEFAULT_COLOR = "#757575"


def _commas(text: str) -> tuple[str, ...]:
    return tuple(t.strip() for t in text.replace("\n", " ").split(",") if t.strip())


@dataclass(frozen=True)
class Abbreviations:
    """An immutable dictionary; adding gives a new one, in which the later entry wins."""

    entries: tuple[tuple[str, str], ...]

    @classmethod
    def builtin(cls) -> Abbreviations:
        return cls(tuple(tuple(line.split(" = ", 1)) for line in ABBREVIATION_TEXT.strip().splitlines()))

    def added(self, more: dict[str, str]) -> Abbreviations:
        return replace(self, entries=tuple((dict(self.entries) | more).items()))

    @cached_property
    def mapping(self) -> dict[str, str]:
        return dict(self.entries)

    def __len__(self) -> int:
        return len(self.mapping)


@dataclass(frozen=True)
class Gazetteers:
    """Terms by entity type, in lower case without accents."""

    medications: tuple[str, ...] = _commas(MEDICATION_TEXT)
    conditions: tuple[str, ...] = _commas(CONDITION_TEXT)
    procedures: tuple[str, ...] = _commas(PROCEDURE_TEXT)

    def by_type(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        return (("MEDICAMENTO", self.medications), ("CONDICAO", self.conditions), ("PROCEDIMENTO", self.procedures))
