"""Messages made from the documents table: every document is the body of one, with a sender, headers and a first line by turns.

The turns (CASES) hold what the rules look for, so that each rule meets rows that fire it and rows that don't, in all texts.
"""

from __future__ import annotations

#: sender, reply-to, authentication results (hops parted by ~), subject, first lines (parted by ~), link text, link target, hidden text.
CASES = (
    ("Blue Shop Alerts <alerts@blueshop.example.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Receipt for order 4417", "Order total: Rs. 1,24,999.50~You saved Rs. 300 on this order.", "order page", "https://blueshop.example.com/o/4417", ""),
    ("SBI Care <kyc@sbi-kyc.in>", "help@gmail.com", "mx.google.com; spf=fail; dkim=fail; dmarc=fail", "Re: URGENT kyc update", "Your account will be blocked within 24 hours. Update your KYC now.", "sbi.co.in", "http://sbi-kyc.in/login", "verify here"),
    ("Dr. Ada Lovelace (Team) <ada@mail.example.co.uk>", "ada@mail.example.co.uk", "mx.google.com; spf=pass; dkim=none; dmarc=pass", "Fwd: notes of 5 Nov", "Hi, see https://notes.example.co.uk/a?b=1, and www.example.org.", "", "https://notes.example.co.uk/a?b=1", ""),
    ("HDFC Bank <no-reply@hdfcbamk.com>", "", "relay.example.net; spf=pass~mx.google.com; spf=softfail; dkim=fail; dkim=pass; dmarc=none", "Statement", "Enter your password to open the file. Do not share your OTP with anyone.", "hdfcbank.com", "http://203.0.113.9/open", ""),
    ("plain@example.com", "", "", "lunch", "Lunch at noon? No money, no links.", "", "", ""),
    ("Netflix <billing@netflix.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Your subscription", "Your plan renews on 5 Nov. You paid $15.49 per month.~Total: $15.49", "netflix.com", "https://www.netflix.com/account", ""),
    ("Paytm Support <refunds@paytm.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Refund processed", "Refund of ₹2,499 credited back to your wallet. Available balance ₹12,310.75 | Cashback ₹50", "paytm.com", "https://paytm.com/r", ""),
    ("Prize Desk <winner@lucky-draw.xn--p1ai.example>", "claims@yahoo.com", "mx.google.com; spf=neutral; dkim=none; dmarc=fail", "Congratulations", "Congratulations, you are selected for a prize! Send the gift card codes to me urgently.", "claim", "https://bit.ly/3xYz", "lottery"),
    ("Amazon.in Orders <orders@amazon.in>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "RE: fw: order 88 confirmed", "Item total INR 700~Subtotal 700 inr~Discount Rs 100~Grand total: INR 650.00", "amazon.in", "https://www.amazon.in/gp/88", ""),
    ("Microsoft <security@micros0ft.com>", "", "mx.google.com; spf=none; dkim=none", "Sign in", "Sign in now to verify your account immediately.", "microsoft.com/security", "https://micros0ft.com/x", ""),
    ("Paypal Service <service.desk@gmail.com>", "other@gmail.com", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Invoice", "Pay the security deposit of $250 to release your parcel. Share your one-time password and CVV today itself.", "paypal.com", "http://paypal.com.pay-now.example.org/", ""),
    ("Electric Board <bill@power.gov.in>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=bestguesspass", "Bill of June", "Amount due: Rs. 1,845.00 by the due date 2024-02-20.", "bill", "https://power.gov.in/bill", ""),
    ("Deals <deals@shop.example.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Sale ends tonight", "Up to 70% off, use code SALE. Starting at $9, shop now. Deal of the day $5.", "shop now", "https://shop.example.com/sale", ""),
    ("Kotak Alerts <alerts@kotak.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Debit alert", "Rs 5,000.00 debited at Meadow Stores on 3 Feb. Available limit Rs 45,000.", "", "", ""),
    ("Linked Jobs <jobs@linkedln.com>", "", "mx.google.com; spf=pass; dkim=fail; dmarc=fail", "You won a job", "Pay a registration fee of 499 rupees. Approve the collect request to receive the refund.", "linkedin.com", "https://linkedln.com/jobs", ""),
    ("Grace Hopper <grace@meadowbank.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Re: Re: minutes", "Hello Ada,~I attached the minutes — please look.~- one~- two~On Monday Ada wrote:~> hello", "meadowbank.com", "https://meadowbank.com/m", ""),
    ("Meadow Bank <info@meadowbamk.com>", "", "mx.google.com; spf=fail; dkim=pass; dmarc=fail", "Your card", "Your card has been temporarily suspended. Call +91 98765 43210 or write to help@okbank now, PAN ABCDE1234F.", "meadowbank.com", "https://meadowbamk.com/", ""),
    ("Cloud <noreply@cloud.example.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Membership renewal", "Your membership renews annually; next payment from January 31, 2025. Charged EUR 99.00 and £4.", "terms", "https://cloud.example.com/t", ""),
    ('"Quoted, Name" <q@quoted.co.za>', "x@other.co.za", "mx.google.com; spf=temperror; dkim=neutral; dmarc=policy", "", "A zero €0.00, a huge $99999999999.99, and 12.345.678 of nothing.", "other.co.za", "https://other.co.za/", ""),
    ("", "", "", "no sender", "1234567 and (022) 2345 6789, a.b+c@mail.example.com at the end.", "", "mailto:x@example.com", ""),
    ("Apple <id@apple.com.verify-id.example.net>", "", "mx.google.com; spf=none; dkim=none; dmarc=none", "Verify", "Scan this QR to receive the payment. Password: share karo abhi.", "apple.com", "https://apple.com.verify-id.example.net", ""),
    ("Team Notes <notes@notes.bank.in>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "weekly notes 12 / 2024", "Thanks, regards~-----Original Message-----~From: a@b.example.com", "x.bank.in", "https://notes.bank.in/w", ""),
    ("ɡооɡle <a@ɡooɡle.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Docs", "A file was shared with you.", "docs", "https://t.co/abc", ""),
    ("Zomato Gold <care@zomato.com>", "", "mx.google.com; spf=pass; dkim=pass; dmarc=pass", "Gold", "Payment successful. You paid Rs. 149 a quarter for the subscription; renews from 12 March.", "zomato.com", "https://zomato.com/gold", ""),
)
COLUMNS = "sender reply auth subject_line opening label href hidden".split()
#: Domains that the user relies on.
TRUSTED = ("meadowbank.com", "example.com")


def literal(s: str) -> str:
    if "'" in s or "\\" in s:
        raise ValueError(f"no quote marks in {s!r}")
    return f"'{s}'"


def messages(d) -> str:
    """id, account, received, sender, reply, auth, subject, body, label, href, hidden; of all documents."""
    cases = ", ".join(f"({k}, {', '.join(literal(x) for x in c)})" for k, c in enumerate(CASES))
    received = "date_add(DATE '2024-01-01', CAST(doc_id % 60 AS INT))" if d.name == "spark" else "CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE)"
    return f"""(SELECT doc_id AS id, source AS account, {received} AS received, sender, reply, auth, subject_line AS subject, concat(replace(opening, '~', chr(10)), chr(10), coalesce(text, '')) AS body, label, href, hidden
      FROM documents JOIN (VALUES {cases}) AS cases(k, {', '.join(COLUMNS)}) ON cases.k = doc_id % {len(CASES)})"""
