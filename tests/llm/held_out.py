"""Labelled rows that the field of personal data is not trained on; values and sentences are invented."""

ROWS = """\
please call [crf_phone|(617) 555-0188] now
you can phone [crf_phone|704-555-0126] before ten
mobile: [crf_phone|0151 5566 7788] any time
téléphone [crf_phone|04 78 55 21 60] le matin
fax [crf_phone|(0711) 445-1200] only
ring [crf_phone|555-0161] for help
telefon [crf_phone|(040) 555-3321] bis acht
the front desk is at [crf_phone|312-555-0148] all day
her ssn is [crf_id|321-54-9876] here
ssn: [crf_id|455-81-2093] verified
social security [crf_id|228-63-1174] was stolen
patient [crf_id|509-27-6618] is waiting
his passport no. [crf_id|K2LMNP7Q3] was found
passport [crf_id|B47Y8801R] is missing
write to [crf_email|lena@mailhost] today
contact [crf_email|admin@server] tonight
from [crf_email|p.noor@intranet] at noon
iban [crf_account|DE44 5001 0517 5407 3249 31] was used
pay to [crf_account|GB33 BUKB 2020 1555 5555 55] today
iban: [crf_account|NL20INGB0001234567] and name
the account [crf_account|AT48 3200 0000 1234 5864] is empty
mr. [crf_name|Oscar Lindgren] came in
mrs. [crf_name|Hanna Verbeek] was late
dr. [crf_name|Paul Adeyemi] will call
frau [crf_name|Marta Heller] ist da
herr [crf_name|Jan Brückner] kommt morgen
madame [crf_name|Élise Caron] est là
señora [crf_name|Carmen Ortega] llama
my name is [crf_name|Sofia Brandt] and
prof. [crf_name|Dina Rahman] gave a talk
signed [crf_name|Arthur Bell] in blue
dear [crf_name|Martin] we thank you
he lives at [crf_address|77 Maple Street] now
she moved to [crf_address|19 Station Road] in may
the shop at [crf_address|402 Ocean Avenue] is open
wohnt in der [crf_address|Bergstraße 9] oben
adresse [crf_address|Mühlgasse 12] im dorf
vive en [crf_address|Calle Sol 45] con ella
from [crf_address|6 Mill Lane] to the sea
she was born on [crf_birth|9 April 1977] there
born [crf_birth|1992-01-08] in june
geboren am [crf_birth|24.09.1981] in bonn
dob: [crf_birth|1969-12-25] female
he was born [crf_birth|11/05/1983] abroad
in 1984 about 300 people came
version 3.1.4 of the tool
sum of 8120446093371 and 77
commit 71ac05de93bf4c2688e1d7340fb9a25c
on 2021-08-19 the store closed
the third street was closed in 2003
we opened an account in 1998
items 5 6 7 8 and 9 remain
the road is 40 miles long
they called it a good name for 3 ships
pages 12-19 are torn
the phone has 2 buttons
version 12 was signed on 3 May 2010
a lane with 8 houses
we were born to win
the avenue was named after a queen
dear friends and family of ours
user @ home and @page too
between 1990 and 1995 sales rose 12 percent
gate 4 and door 17 open at 9
"""
